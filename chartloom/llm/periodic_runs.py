"""Runs of periodically repeated words, by suffix automaton.

A state of the automaton stands for the word sequences that end at the same
places.  End-position sets are merged up the suffix links, the smaller into the
larger.  Where places x < y become neighbours in a state of length n, the words
up to both agree for just n words; if y - x <= n this is a square, and as no
place between them ends the same words, y - x is its smallest period.  Its run
starts at x - n + 1 and cannot be extended to the left; the last y of all such
pairs with one start and period is the run's end.

Only words that a wanted run can hold go into an automaton: in a run all
sequences of GRAM words recur, so a text is first cut, again and again, at those
that recur too seldom.  Most texts have nothing left then.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import store

MIN_LENGTH = 6
MIN_EXPONENT = 4
GRAM = 3
BLANK = r"[\x20\x09-\x0D]+"
RUN = "struct<start: bigint, length: bigint, period: bigint>"
RESULT = f"struct<runs: array<{RUN}>, collapsed: string>"


def least_recurrence(min_length: int, min_exponent: int) -> int:
    """How often every sequence of GRAM words occurs, at least, in a run of that length and exponent, whatever its period."""
    return min((max(min_length, min_exponent * q) - GRAM + 1) // q for q in range(1, max(min_length, GRAM) + 1))


def stretches(ids: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``ids`` outside of which no run can lie."""
    least, size = least_recurrence(min_length, min_exponent), max(min_length, GRAM)
    left = [(0, len(ids))]
    while left:
        begin, end = left.pop()
        if end - begin < size:
            if least < 1 or min_length < GRAM:
                yield begin, end
            continue
        part = np.unique(ids[begin:end], return_inverse=True)[1]
        grams = part[: 1 - GRAM].astype(np.int64)
        for k in range(1, GRAM):
            grams = grams * len(part) + part[k : len(part) - GRAM + 1 + k]
            grams = np.unique(grams, return_inverse=True)[1].astype(np.int64) if k < GRAM - 1 else grams
        _, where, counts = np.unique(grams, return_inverse=True, return_counts=True)
        often = counts[where] >= least
        if often.all():
            yield begin, end
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, often, False]))
        left += [(begin + int(a), begin + int(b) + GRAM - 1) for a, b in zip(edges[::2], edges[1::2])]


class Automaton:
    """The suffix automaton of ``ids``; most states have one transition, which lies in two arrays."""

    def __init__(self, ids: list[int]) -> None:
        self.length, self.link, self.end = array("q", [0]), array("q", [-1]), array("q", [-1])
        only_id, only_to, more = array("q", [-1]), array("q", [-1]), {}
        length, link, last = self.length, self.link, 0

        def put(state: int, c: int, to: int) -> None:
            if state in more:
                more[state][c] = to
            elif only_id[state] in (-1, c):
                only_id[state], only_to[state] = c, to
            else:
                more[state] = {only_id[state]: only_to[state], c: to}

        def new(n: int, to: int, end: int) -> int:
            for a, v in ((length, n), (link, to), (self.end, end), (only_id, -1), (only_to, -1)):
                a.append(v)
            return len(length) - 1

        for at, c in enumerate(ids):
            state, p = new(length[last] + 1, 0, at), last
            found = -1
            while p >= 0:
                found = more[p].get(c, -1) if p in more else only_to[p] if only_id[p] == c else -1
                if found >= 0:
                    break
                put(p, c, state)
                p = link[p]
            if p >= 0:
                if length[found] == length[p] + 1:
                    link[state] = found
                else:
                    twin = new(length[p] + 1, link[found], -1)
                    only_id[twin], only_to[twin] = only_id[found], only_to[found]
                    if found in more:
                        more[twin] = dict(more[found])
                    link[found] = link[state] = twin
                    while p >= 0 and (more[p].get(c, -1) if p in more else only_to[p] if only_id[p] == c else -1) == found:
                        put(p, c, twin)
                        p = link[p]
            last = state


def _join(sets: list[list[int]], base: list[int]) -> Iterator[tuple[int, int]]:
    """Merge ``sets`` into ``base``, all of them places in falling order as negative numbers; the neighbours (x, y) that come from two of them."""
    owner = {v: k for k, s in enumerate(sets) for v in s}
    if 16 * len(owner) > len(base):
        base.extend(v for s in sets for v in s)
        base.sort()
    else:
        for v in owner:
            insort(base, v)
    for v, k in owner.items():
        at = bisect_left(base, v)
        if at and owner.get(base[at - 1], -1) != k:
            yield -v, -base[at - 1]
        if at + 1 < len(base) and owner.get(base[at + 1], -1) != k:
            yield -base[at + 1], -v


def find_runs(ids: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``ids`` with length >= max(min_length, min_exponent * period), by start and period.

    ``min_exponent`` is 2 or more.  Time is that of sorting the stretches left
    by the cut, and memory about 100 bytes for each of their words.
    """
    found: dict[tuple[int, int], int] = {}
    # A pair of places that ends a wanted run agrees for so many words.
    least = min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))
    for begin, stop in stretches(np.asarray(ids, np.int64), min_length, min_exponent):
        part = ids[begin:stop]
        a = Automaton(part)
        below: dict[int, list[list[int]]] = {}
        for state in np.argsort(np.frombuffer(a.length, np.int64), kind="stable")[::-1].tolist():
            n = a.length[state]
            if n < least:
                break
            sets = below.pop(state, [])
            if a.end[state] >= 0:
                sets.append([-a.end[state]])
            base = max(sets, key=len)
            if len(sets) > 1:
                for x, y in _join([s for s in sets if s is not base], base):
                    d = y - x
                    if (min_exponent - 1) * d <= n and n + d >= min_length:
                        key = (begin + x - n + 1, d)
                        found[key] = max(found.get(key, 0), begin + y)
            below.setdefault(a.link[state], []).append(base)
    return sorted((s, y - s + 1, d) for (s, d), y in found.items())


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(change).tolist()) if not gone]


def detect(text: Column | str, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Column:
    """A struct of ``runs`` (word number, length and period of each, by start and period) and the ``collapsed`` text.

    Words are parted by ASCII blanks and numbered from 0; the collapsed text has
    one space between them.  A null or blank text has no run and collapses to the
    empty string.  The result depends on the text alone, so equal rows are equal,
    and it replaces no column.
    """

    @F.arrow_udf(RESULT)
    def found(texts):
        import pyarrow as pa

        runs, left = [], []
        for raw in texts.to_pylist():
            words, number = (raw or b"").split(), {}
            of_text = find_runs([number.setdefault(w, len(number)) for w in words], min_length, min_exponent)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in of_text])
            left.append(b" ".join(collapse(words, of_text)))
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.StructArray.from_arrays([pa.array(runs, pa.list_(run)), pa.array(left, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return found(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def find(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed`` (see ``detect``); columns of those names are replaced, all others kept."""
    store.small_batches(docs.sparkSession)
    keep = store.others(docs, "runs", "collapsed")
    return docs.select(*keep, detect(text_column).alias("__found")).select(*keep, "__found.runs", "__found.collapsed")


def planted(key: Column, text: Column) -> Column:
    """The text whose words, for every tenth hash of a key, go on with a period from some place."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, BLANK), "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)
    return F.when(h % 10 == 0, made).otherwise(text)


def _best(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equal ones."""
    none = F.lit(None).cast(RUN)
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir, "doc_id", "text").select("doc_id", planted(F.col("doc_id"), store.text_of()).alias("text"))
    best = _best(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    digests = find(docs).select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return digests.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")
