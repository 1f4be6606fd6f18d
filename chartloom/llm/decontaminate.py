"""Benchmark decontamination by the q-gram lemma.

The shortest passage that counts has WINDOW bytes, or the whole item where that
is shorter: a text matches when a place in it is within k = RATE m edits of any m
consecutive bytes of an item, at whatever offset.  Such a place shares at least
m + 1 - q (k + 1) q-grams with those m bytes, all within k diagonals of each
other (text position - item position).  So shared q-grams are counted in
diagonal bands 2k + 2 wide that overlap by half; in bands that reach the bound,
so are those of each m bytes, and what reaches it is verified by banded
alignment: all half-overlapping windows, and of those at every other offset each
whose place may lie outside the spans that the former leave.  The spans are
those of the windows that match.  No match within the budget is missed: it is in
a span of its item or overlaps one.  One rule holds whatever the sizes of texts,
items, blocks and steps are; they decide how the work is cut only.

q-grams are 8 bytes, kept exactly as 64-bit numbers.  Texts and items are
compared with ASCII letters lower-cased and white-space bytes as spaces.

In an item under 3 q = 24 bytes the lemma guarantees nothing; it counts verbatim,
where no letter or digit adjoins one of its own.

Grams that recur (rules of dashes, tables) are counted in bounded steps: where a
text has many hits, each place is decided at the first that equals it, with all
around it that can matter, and against few items at a time; what is found there
holds for its equals too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from chartloom.llm import store
from chartloom.llm.words import mix, run_hashes, slices, spread

Q, WINDOW, RATE = 8, 96, 0.1
#: Items are taken in blocks of at most this many bytes; a block's index is what is broadcast.
BLOCK_BYTES = 4 << 20
#: Longer items are cut into segments of this many characters, which overlap by WINDOW.
SEGMENT_CHARS = 16_384
#: So many (text position, item position) hits are counted at once; texts with more take the way for recurring grams.
MAX_HITS = 2_000_000
#: Recurring grams are counted against items of about this many bytes at a time.
PART_BYTES = 16_384
#: Longer texts are searched by stretches of this many bytes.
STRETCH = 2 << 20
#: With several blocks of items, a task holds this many bytes of text while it takes the blocks in turn.
GROUP_BYTES = 48 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_BITS = 22
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as a number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


class Short:
    """Items too short for the lemma, sought verbatim between word boundaries."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.by_length: dict[int, tuple] = {}
        for n in sorted({len(data) for _, data in items}):
            same = [(i, data) for i, data in items if len(data) == n]
            flat = np.concatenate([data for _, data in same])
            begin = np.arange(len(same)) * n
            h = run_hashes(flat, begin, begin + n)
            order = np.argsort(h, kind="stable")
            starts = np.zeros(1 << 16, bool)
            starts[self._two(flat, begin, n)] = True
            self.by_length[n] = (h[order], np.array([i for i, _ in same], np.int64)[order], flat.reshape(-1, n)[order], starts)

    @staticmethod
    def _two(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        first = data[at].astype(np.int64) << 8
        return first | data[at + 1] if n > 1 else first

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item, start, end) of every occurrence."""
        out = [np.zeros((4, 0), np.int64)]
        if self.by_length and len(data):
            word = _WORD[data]
            inner = np.zeros(len(data) + 1, bool)  # a letter or digit on both sides
            inner[1:-1] = word[1:] & word[:-1]
            inner[offsets] = False
            start = np.flatnonzero(~inner[:-1])
            row = np.searchsorted(offsets, start, "right") - 1
            room = offsets[row + 1] - start
            for n, (hashes, ids, raw, firsts) in self.by_length.items():
                fits = np.flatnonzero(room >= n)
                fits = fits[firsts[self._two(data, start[fits], n)]]
                fits = fits[~inner[start[fits] + n]]
                h = run_hashes(data, start[fits], start[fits] + n)
                low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
                which = np.repeat(fits, high - low)
                item = spread(low, high - low)
                if len(which):
                    same = (data[start[which][:, None] + np.arange(n)] == raw[item]).all(axis=1)
                    which, item = which[same], item[same]
                at = start[which] - offsets[row[which]]
                out.append(np.array([row[which], ids[item], at, at + n]))
        return np.concatenate(out, axis=1)


def _no_spans() -> list[np.ndarray]:
    return [np.zeros(0, np.int64)] * 5


def _joined(row, item, start, end, edits) -> list[np.ndarray]:
    """Spans by row, item and start; those of one row and item that overlap or touch become one, with the least edits."""
    if not len(row):
        return _no_spans()
    order = np.lexsort((start, item, row))
    row, item, start, end, edits = (x[order] for x in (row, item, start, end, edits))
    pair = np.cumsum(np.r_[0, (np.diff(row) != 0) | (np.diff(item) != 0)]) * (int(end.max()) + 2)
    last = np.maximum.accumulate(pair + end)
    new = np.flatnonzero(np.r_[True, (pair + start)[1:] > last[:-1]])
    return [row[new], item[new], start[new], (last - pair)[np.r_[new[1:], len(row)] - 1], np.minimum.reduceat(edits, new)]


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, rate: float = RATE) -> None:
        whole = [(i, _FOLD[np.frombuffer((text or "").encode(), np.uint8)]) for i, text in items]
        self.short = Short([(i, data) for i, data in whole if 0 < len(data) < 3 * Q])
        self._build([(i, data) for i, data in whole if len(data) >= 3 * Q], window, rate)

    def _build(self, whole: list[tuple[int, np.ndarray]], window: int, rate: float) -> None:
        self.window, self.rate = window, rate
        self.item = np.array([i for i, _ in whole], np.int64)
        self.parts = [data for _, data in whole]
        self.length = np.array([len(p) for p in self.parts], np.int64)
        self.half = window // 2
        self.m = np.minimum(self.length, window)
        self.k = (self.m * rate).astype(np.int64)
        self.need = np.maximum(self.m + 1 - Q * (self.k + 1), 1)
        self.reach = int((self.m + self.k).max()) if whole else 0  # no match is longer
        self.wide = int((self.m + 4 * self.k + 2).max()) if whole else 0  # nor any place that a candidate is aligned in
        g = [grams(p) for p in self.parts]
        gram = np.concatenate(g) if g else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(g)), [len(x) for x in g]) if g else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.gram, first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.first = first
        self.bits = min(_BITS, max(10, (16 * len(self.gram)).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.gram)] = True
        self._few: list[Index] | None = None

    def _slot(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(g) >> np.uint64(64 - self.bits)).astype(np.int64)

    def few(self) -> list[Index]:
        """The same items in several indexes of about PART_BYTES and one budget each; ``number`` tells which they are here."""
        if self._few is None:
            self._few = []
            for k in np.unique(self.k):
                same = np.flatnonzero(self.k == k)
                part = np.cumsum(self.length[same]) // PART_BYTES
                for p in np.unique(part):
                    one = Index.__new__(Index)
                    one.number = same[part == p]
                    one._build([(int(self.item[i]), self.parts[i]) for i in one.number], self.window, self.rate)
                    self._few.append(one)
        return self._few

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item, start, end, edits) of all matches in a slice of folded texts; each row's spans may overlap."""
        found = [np.zeros((5, 0), np.int64)]
        for first, last, low, high in self._stretches(offsets):
            bounds = np.clip(offsets[first : last + 1], low, high) - low
            some = data[low:high]
            shift = low - offsets[first]  # not 0 only within one long text
            row, item, start, end = self.short.find(some, bounds)
            if shift and len(row):  # a stretch begins inside the text: what adjoins is not seen there
                row, item, start, end = (x[start > 0] for x in (row, item, start, end))
            if high < offsets[last] and len(row):
                row, item, start, end = (x[end < high - low] for x in (row, item, start, end))
            found.append(np.array([row + first, item, start + shift, end + shift, np.zeros(len(row), np.int64)]))
        found.append(self._search(data, offsets))
        return np.concatenate(found, axis=1)

    def _stretches(self, offsets: np.ndarray):
        """(first row, last row + 1, low, high): the slice whole, or its one long text in overlapping stretches."""
        n, overlap = len(offsets) - 1, self.reach + 4 * Q
        if n != 1 or offsets[-1] <= STRETCH:
            yield 0, n, 0, int(offsets[-1])
            return
        for low in range(0, int(offsets[-1]), STRETCH - overlap):
            yield 0, 1, low, min(low + STRETCH, int(offsets[-1]))

    def _search(self, data, offsets):
        found = [np.zeros((5, 0), np.int64)]
        hot = np.full(len(offsets) - 1, len(offsets) == 2 and offsets[-1] > STRETCH)
        if not hot.any():
            at, j, row, each = self._hits(data, offsets)
            per_row = np.bincount(row, weights=each, minlength=len(offsets) - 1)
            hot = per_row > MAX_HITS
            group = np.cumsum(np.where(hot, 0, per_row)) // MAX_HITS
            for g in np.unique(group[row[~hot[row]]]):
                mine = ~hot[row] & (group[row] == g)
                found.append(np.array(self.verify(data, offsets, *self._bands(at[mine], j[mine], row[mine], each[mine], offsets))))
        for r in np.flatnonzero(hot):
            got = self._in_steps(data[offsets[r] : offsets[r + 1]])
            got[0] += r
            found.append(got)
        return np.concatenate(found, axis=1)

    def _in_steps(self, text: np.ndarray) -> np.ndarray:
        """What ``verify`` finds in one text that is long or has many hits, a bounded number of them at a time."""
        offsets = np.array([0, len(text)])
        found = _no_spans()
        for item, begin, band, equal in self._candidates_in_steps(text):
            coarse = self._coarse(item, begin)
            found = self._add(found, text, offsets, item[coarse], begin[coarse], band[coarse], equal, self._aligned)
        cover, found = found, _no_spans()
        for item, begin, band, equal in self._candidates_in_steps(text):
            left = ~self._coarse(item, begin)
            left[left] = self._uncovered(offsets, cover, np.zeros(left.sum(), np.int64), item[left], begin[left], band[left])
            found = self._add(found, text, offsets, item[left], begin[left], band[left], equal, self._others)
        row, item, start, end, edits = (np.concatenate(x) for x in zip(cover, found))
        return np.array([row, self.item[item], start, end, edits])

    def _add(self, found, text, offsets, item, begin, band, equal, align):
        """``found`` with the matches of candidates, and what equals these."""
        which, start, end, edits = align(text, offsets, np.zeros(len(item), np.int64), item, begin, band)
        item, place = item[which], self._place(item, begin, band)[which]
        if equal is not None and len(item):
            first, low = equal
            # Windows of one item and place often agree.
            (item, place, start, end), which = np.unique(np.array([item, place, start, end]), axis=1, return_inverse=True)
            least = np.full(len(item), len(text), np.int64)
            np.minimum.at(least, which.ravel(), edits)
            order = np.argsort(first, kind="stable")
            at = np.searchsorted(first[order], place)
            n = np.searchsorted(first[order], place, "right") - at
            step = np.cumsum(n) // MAX_HITS
            for g in np.unique(step):
                mine = step == g
                shift = low + order[spread(at[mine], n[mine])] - np.repeat(place[mine], n[mine])
                one, s, e, d = (np.repeat(x[mine], n[mine]) for x in (item, start, end, least))
                found = _joined(*[np.concatenate(x) for x in zip(found, (np.zeros(len(one), np.int64), one, s + shift, e + shift, d))])
            return found
        return _joined(*[np.concatenate(x) for x in zip(found, (np.zeros(len(item), np.int64), item, start, end, edits))])

    def _candidates_in_steps(self, text: np.ndarray):
        """(item, begin, band, equal) of a text's candidates; with ``equal`` of those only whose place is the first of its equals."""
        offsets = np.array([0, len(text)])
        for low in range(-self.wide, len(text), STRETCH):
            high = min(low + STRETCH, len(text))
            begin = max(low, 0)
            some = text[begin : min(high + self.wide, len(text))]
            at, j, _, each = self._hits(some, np.array([0, len(some)]))
            if each.sum() <= MAX_HITS:
                _, item, start, band = self._bands(at + begin, j, np.zeros(len(at), np.int64), each, offsets)
                place = self._place(item, start, band)
                good = (place >= low) & (place < high)
                yield item[good], start[good], band[good], None
                continue
            equals = {}
            for few in self.few():
                at, j, _, each = few._hits(some, np.array([0, len(some)]))
                if not len(at):
                    continue
                step = int(few.k[0]) + 1
                if step not in equals:
                    equals[step] = self._equals(text, low, high, step)
                first, kept = equals[step]
                good = kept[at] & kept[at + Q - 1]
                at, j, each = at[good] + begin, j[good], each[good]
                total, a = np.r_[0, np.cumsum(each)], 0
                while a < len(at):
                    b = int(np.searchsorted(total, total[a] + MAX_HITS, "right")) - 1
                    b = max(b, int(np.searchsorted(at, at[a] + 2 * self.wide)))
                    s = slice(a, b)
                    _, item, start, band = few._bands(at[s], j[s], np.zeros(len(at[s]), np.int64), each[s], offsets)
                    place = few._place(item, start, band)
                    good = (place >= low) & (place < high)
                    good[good] = first[place[good] - low] == place[good]
                    yield few.number[item[good]], start[good], band[good], (first, low)
                    if b >= len(at):
                        break
                    a = max(a + 1, int(np.searchsorted(at, at[b] - self.wide)))

    def _equals(self, text: np.ndarray, low: int, high: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """For places that begin at low..high the first equal one, a multiple of ``step`` before; and marks of the text that these first ones hold.

        Equal: with as much text on either side, which decides what other windows
        list there.  Near the ends of the text every place is its own.
        """
        wide, begin = self.wide, max(low, 0)
        place = np.arange(low, high)
        first = place.copy()
        inner = place[(place >= wide) & (place + 2 * wide <= len(text))]
        if len(inner):
            base = inner[0] - wide
            h = run_hashes(text[base : inner[-1] + 2 * wide], inner - wide - base, inner + 2 * wide - base)
            for r in range(step):
                mine = np.flatnonzero(inner % step == r)
                _, one, same = np.unique(h[mine], return_index=True, return_inverse=True)
                first[inner[mine] - low] = inner[mine[one[same]]]
        own = place[first == place] - begin
        size = min(high + wide, len(text)) - begin
        change = np.zeros(size + 1, np.int64)
        np.add.at(change, np.clip(own, 0, size), 1)
        np.add.at(change, np.clip(own + wide, 0, size), -1)
        return first, np.cumsum(change[:-1]) > 0

    def _hits(self, data: np.ndarray, offsets: np.ndarray):
        """Text positions of known grams, the gram's number, the row and in how many item positions it is."""
        g = grams(data)
        at = np.flatnonzero(self.seen[self._slot(g)]) if len(g) and len(self.gram) else np.zeros(0, np.int64)
        j = np.searchsorted(self.gram, g[at])
        j = np.minimum(j, max(len(self.gram) - 1, 0))
        good = self.gram[j] == g[at] if len(at) else np.zeros(0, bool)
        at, j = at[good], j[good]
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + Q <= offsets[row + 1] if len(at) else np.zeros(0, bool)
        at, j, row = at[whole], j[whole], row[whole]
        return at, j, row, self.count[j] if len(j) else np.zeros(0, np.int64)

    def candidates(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item number, begin in the item, band) with enough shared q-grams; a band starts at diagonal band * (k + 1)."""
        return self._bands(*self._hits(data, offsets), offsets)

    def _bands(self, at, j, row, each, offsets):
        hit = spread(self.first[j] if len(j) else np.zeros(0, np.int64), each)
        item, place = self.owner[hit], self.place[hit]
        row = np.repeat(row, each)
        diagonal = np.repeat(at - offsets[row[np.r_[0, np.cumsum(each)[:-1]]]] if len(at) else at, each) - place
        step = self.k[item] + 1
        band = diagonal // step
        if not len(row):
            z = np.zeros(0, np.int64)
            return z, z, z, z
        # Each diagonal lies in two bands: that of its own step and the next, or of the step before and its own.
        span = int(band.max() - band.min()) + 3
        least = int(band.min())
        own = (row * len(self.parts) + item) * span + (band - least + 1)
        key, n = np.unique(own, return_counts=True)
        after = np.zeros(len(key), np.int64)
        after[:-1] = np.where(np.diff(key) == 1, n[1:], 0)
        lone = np.r_[True, np.diff(key) != 1]  # a band whose own step has no hit, but the next has
        key, n = np.r_[key, key[lone] - 1], np.r_[n + after, n[lone]]
        key = np.unique(key[n >= self.need[key // span % len(self.parts)]])
        which, begin = self._windows(key, own, place, key // span % len(self.parts))
        key = key[which]
        return key // span // len(self.parts), key // span % len(self.parts), begin, key % span - 1 + least

    def _windows(self, key: np.ndarray, own: np.ndarray, place: np.ndarray, item: np.ndarray):
        """(number of the key, begin) of every m bytes of its item that have enough hits in the key's band."""
        z = np.zeros(0, np.int64)
        if not len(key):
            return z, z
        at, places = [], []
        for shift in (0, 1):  # a band holds the hits of its own step and of the next
            j = np.minimum(np.searchsorted(key, own - shift), len(key) - 1)
            good = key[j] == own - shift
            at.append(j[good])
            places.append(place[good])
        at, places = np.concatenate(at), np.concatenate(places)
        size = int(self.length.max()) + 1
        spot = np.unique(at * size + places)  # an item position counts once in a band
        low, high = np.searchsorted(spot, np.arange(len(key)) * size), np.searchsorted(spot, np.arange(1, len(key) + 1) * size) - 1
        reach, last = self.m[item] - Q, self.length[item] - self.m[item]
        # Only from where the window ends at the first hit to where it starts at the last one.
        first = np.minimum(np.maximum(spot[low] % size - reach, 0), last)
        n = np.minimum(spot[high] % size, last) - first + 1
        which, begin = np.repeat(np.arange(len(key)), n), spread(first, n)
        count = np.searchsorted(spot, which * size + begin + reach[which], "right") - np.searchsorted(spot, which * size + begin)
        keep = count >= self.need[item[which]]
        return which[keep], begin[keep]

    def verify(self, data, offsets, row, item, begin, band):
        """Banded semi-global alignment of candidates: (row, item, start, end, edits) of those within budget that the rule lists."""
        coarse = self._coarse(item, begin)
        one = [x[coarse] for x in (row, item, begin, band)]
        which, *rest = self._aligned(data, offsets, *one)
        found = [one[0][which], one[1][which], *rest]
        left = [x[~coarse] for x in (row, item, begin, band)]
        open_ = self._uncovered(offsets, _joined(*found), *left)
        left = [x[open_] for x in left]
        which, *rest = self._others(data, offsets, *left)
        row, item, *rest = (np.concatenate(x) for x in zip(found, (left[0][which], left[1][which], *rest)))
        return [row, self.item[item], *rest]

    def _coarse(self, item, begin) -> np.ndarray:
        return (begin % self.half == 0) | (begin == self.length[item] - self.m[item])

    def _place(self, item, begin, band) -> np.ndarray:
        """Where the text begins in which a candidate is aligned; may be before the text."""
        return band * (self.k[item] + 1) - self.k[item] + begin

    def _uncovered(self, offsets, spans, row, item, begin, band) -> np.ndarray:
        """Whether a candidate's place has room for a match outside of the spans of its item."""
        k, m, place = self.k[item], self.m[item], self._place(item, begin, band)
        length = np.diff(offsets)
        size = int(length.max()) + 2
        low = np.clip(place, 0, length[row])
        high = np.clip(place + 4 * k + 2 + m, 0, length[row])
        pair = (row * len(self.parts) + item) * size
        owner = (spans[0] * len(self.parts) + spans[1]) * size
        starts, ends = owner + spans[2], owner + spans[3]
        total = np.r_[0, np.cumsum(ends - starts)]

        def covered(x):
            """Bytes of spans before x."""
            n = np.searchsorted(starts, x, "right")
            return total[n] - np.where(n > 0, np.maximum(np.r_[0, ends][n] - x, 0), 0)

        return high - low - (covered(pair + high) - covered(pair + low)) >= m - k

    def _aligned(self, data, offsets, row, item, begin, band):
        """(number, start, end, edits) of the candidates within budget."""
        found = [[np.zeros(0, np.int64)] * 4]
        for i in range(0, len(row), 2000):
            at = np.arange(i, min(i + 2000, len(row)))
            start, end, best = self._align(data, offsets, row[at], item[at], begin[at], band[at], 0)
            good = best <= self.k[item[at]]
            found.append([at[good], start[good], end[good], best[good]])
        return [np.concatenate(x) for x in zip(*found)]

    def _others(self, data, offsets, row, item, begin, band):
        """As ``_aligned``, for windows at any offset."""
        pair, left, near = row * max(len(self.parts), 1) + item, np.arange(len(row)), []
        # Windows d bytes apart differ by at most d edits: one in the middle of a cell rules out its neighbours.
        for cell in (19, 7, 3):
            if not len(left):
                break
            own = begin[left] // cell
            far = np.abs(begin[left] - own * cell - cell // 2)
            order = np.lexsort((far, own, band[left], pair[left]))
            left, own = left[order], own[order]
            new = np.r_[True, (np.diff(pair[left]) != 0) | (np.diff(band[left]) != 0) | (np.diff(own) != 0)]
            asked, number = left[new], np.cumsum(new) - 1
            margin = int(self.k[item[asked]].max())
            best = np.concatenate([self._align(data, offsets, row[at], item[at], begin[at], band[at], margin)[2] for at in (asked[i : i + 2000] for i in range(0, len(asked), 2000))])
            near.append(asked[best <= self.k[item[asked]]])  # in its own place or in the margin
            reach = np.minimum(best - self.k[item[asked]] - 1, margin)
            left = left[~new & (np.abs(begin[left] - begin[asked][number]) > reach[number])]
        some = np.sort(np.concatenate([*near, left]))
        which, *rest = self._aligned(data, offsets, row[some], item[some], begin[some], band[some])
        return [some[which], *rest]

    def _align(self, data, offsets, row, item, begin, band, margin):
        k, m = self.k[item], self.m[item]
        width = int(4 * k.max() + 2) + 2 * margin  # the band and k + margin diagonals on either side
        low = band * (k + 1) - k - margin + begin  # first diagonal, counted from the window's begin
        n = int(m.max())
        pattern = np.zeros((len(row), n), np.uint8)
        for r, (w, at, size) in enumerate(zip(item.tolist(), begin.tolist(), m.tolist())):
            pattern[r, :size] = self.parts[w][at : at + size]
        length = offsets[row + 1] - offsets[row]
        far = np.int64(1 << 20)
        column = np.arange(width)
        own = (4 * k + 2 + 2 * margin)[:, None]  # a candidate's place does not follow what it is aligned with
        # cost[r, c]: least edits of the first i pattern bytes ending at text position low + c + i; start is free.
        end = low[:, None] + column
        cost = np.where((end >= 0) & (end <= length[:, None]) & (column < own), 0, far)
        origin = np.where(cost == 0, end, 0)
        best, best_end, best_start = np.full(len(row), far), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        text, which = offsets[row], np.arange(len(row))
        for i in range(1, n + 1):
            if i % 16 == 0:  # costs only grow: what is beyond the budget and the margin is left as far
                good = cost.min(axis=1) <= k + margin
                if good.mean() < 0.7:
                    low, length, text, pattern, cost, origin, m, k, which, own = (x[good] for x in (low, length, text, pattern, cost, origin, m, k, which, own))
                    if not len(which):
                        break
            end = low[:, None] + column + i
            ok = (end >= 0) & (end <= length[:, None]) & (column < own)
            at = np.clip(end - 1, 0, np.maximum(length[:, None] - 1, 0)) + text[:, None]
            differs = (data[np.minimum(at, len(data) - 1)] != pattern[:, i - 1 : i]) | (end < 1)
            diagonal = cost + differs
            diagonal = np.where(end < 1, far, diagonal)
            skip = np.full_like(cost, far)  # a pattern byte without a text byte: from the next diagonal
            skip[:, :-1] = cost[:, 1:] + 1
            source = np.zeros_like(origin)
            source[:, :-1] = origin[:, 1:]
            now = np.where(skip < diagonal, skip, diagonal)
            now_origin = np.where(skip < diagonal, source, origin)
            # A text byte without a pattern byte: from the left, any number at once.
            key = np.where(ok, now, far) - column
            least = np.minimum.accumulate(key, axis=1)
            came = np.maximum.accumulate(np.where(key == least, column, 0), axis=1)
            cost = np.where(ok, np.minimum(least + column, far), far)
            origin = np.take_along_axis(now_origin, came, 1)
            done = np.flatnonzero(m == i)
            if len(done):
                c = cost[done].argmin(axis=1)
                to = which[done]
                best[to], best_start[to] = cost[done, c], origin[done, c]
                best_end[to] = low[done] + c + i
        return best_start, best_end, best


_OUT = ArrayType(StructType([StructField("item_id", LongType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("edits", IntegerType())]))


def _groups(batches, several: bool) -> Iterator[list]:
    """The batches one by one, or in groups of about GROUP_BYTES."""
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.nbytes
        if not several or size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _scanner(shared: list):
    def run(batches) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        for group in _groups(batches, len(shared) > 1):
            found: list[list[list]] = [[[] for _ in range(b.num_rows)] for b in group]
            for block in shared:
                index = block.value
                for rows, b in zip(found, group):
                    for first, data, offsets in slices(b.column(1)):
                        for r, item, s, e, d in index.search(_FOLD[data], offsets).T.tolist():
                            rows[first + r].append((item, s, e, d))
                if len(shared) > 1:
                    vars(block).pop("_value", None)  # a worker holds one block at a time; it is read again from its local file
            for rows, b in zip(found, group):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_merge(f) for f in rows], kind)], ["__row", "matches"])

    return run


def _merge(found: list[tuple]) -> list[dict]:
    """Overlapping spans of one item become one; byte positions."""
    out: list[list] = []
    for item, s, e, d in sorted(found):
        if out and out[-1][0] == item and s <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], e), min(out[-1][3], d)
        else:
            out.append([item, s, e, d])
    return [dict(zip(("item_id", "start", "end", "edits"), o)) for o in out]


def blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, long ones in segments, in blocks of bounded size, read one by one."""
    items = benchmark.select(F.col(id_column).cast("bigint").alias("i"), store.text_of(text_column).alias("t"))
    cut = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{SEGMENT_CHARS}}}"), F.lit(0))
    # A segment takes the beginning of the next along; a last one that is in the overlap as a whole goes.
    long = items.where(F.length("t") > SEGMENT_CHARS).select("i", cut.alias("s"))
    long = long.select("i", F.posexplode(F.transform("s", lambda x, k: F.concat(x, F.coalesce(F.left(F.get("s", k + 1), F.lit(WINDOW)), F.lit(""))))).alias("k", "t"))
    items = items.where(F.length("t") <= SEGMENT_CHARS).select("i", F.lit(0).alias("k"), "t").unionAll(long.where(F.length("t") > WINDOW).select("i", "k", "t"))
    size = items.select(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes))
    for b in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("t", "i", "k"), F.lit(n)) == b)
        yield [(r["i"], r["t"]) for r in rows.collect()]  # about block_bytes / 2


def scan(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns (all by default) and ``matches``: (item_id, start, end, edits) with byte positions.

    Null and empty texts have no match, nor has anything with an empty
    benchmark; null and empty items match nothing.  Every passage of a text is
    listed, however often it recurs.  Equal rows get equal results; a column named
    ``matches`` is replaced.  The documents are read once: a task takes the blocks
    of items in turn.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c in store.others(docs, "matches")]
    source = docs.select(F.struct(*keep or [F.lit(0).alias("__none")]).alias("__row"), F.col(text_column).alias("__text"))
    schema = StructType([source.schema["__row"], StructField("matches", _OUT)])
    shared = [spark.sparkContext.broadcast(Index(block)) for block in blocks(benchmark, block_bytes=block_bytes)]
    out = source.mapInArrow(_scanner(shared), schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], F.array_sort("matches").alias("matches"))


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without those that match an item."""
    return scan(docs, benchmark, text_column).where(F.size("matches") == 0).drop("matches")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir, "doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["start"], m["end"], m["edits"]))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), items.alias("item_ids"), F.array_join(spans, ",").alias("spans"))
