"""Exact token ids and counts with a per-worker cache of independent text chunks.

Each supported tokenizer never lets a token cross the gap before a space that
is followed by a non-space.  Texts are cut there, chunks are looked up by hash,
and only chunks not met before go to the tokenizer library, many at a time.
A chunk counts as met when its bytes equal those kept with the hash, so the
result is the library's on whole texts; the tests compare the two.

The cache lives in the Python worker (workers are reused between tasks) and is
emptied once it holds too many chunks or bytes, so memory stays bounded at any
corpus size.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np

from chartloom.llm.words import HashIndex, run_hashes, runs, slices, spread

_loaded: dict[tuple, object] = {}

_BLANK = np.zeros(256, bool)
_BLANK[32] = True
_LINE = _BLANK.copy()
_LINE[10] = True
#: Bytes that may begin or be white space: no cut before them.
_UNSURE = np.zeros(256, bool)
_UNSURE[list(range(9, 14)) + list(range(28, 33)) + [0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_digest(path: str) -> str:
    """Identifies a tokenizer version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: A worker keeps at most this many bytes of chunks (or one slice's, where that is more).
CACHE_BYTES = 64 << 20


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _first_words(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each chunk as two numbers, zero beyond its end."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    word = np.ndarray((len(data) + 16,), "<u8", padded, strides=(1,))
    return word[starts] & _MASK[np.minimum(size, 8)], word[starts + 8 * (size > 8)] & _MASK[np.clip(size - 8, 0, 8)]


class _Chunked:
    def __init__(self, bits: int = 22) -> None:
        self.index = HashIndex(bits)
        self._reset()

    def _reset(self) -> None:
        self.index.clear()
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.from_ = np.zeros(self.index.capacity + 1, np.int64)  # where each chunk begins in bytes
        self.head = np.zeros((2, self.index.capacity + 1), np.uint64)  # its first 16 bytes

    def _chunks(self, data, offsets):
        """Start, end and row of the chunks."""
        raise NotImplementedError

    def _store(self, chunks: list[str]) -> None:
        """Encode new chunks and append their results, in this order."""
        raise NotImplementedError

    def _keep(self, data, starts, ends) -> None:
        """Encode the chunks data[start:end] and append them and their results as the next entries."""
        raw = data.tobytes()
        pieces = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        self._store([p.decode() for p in pieces])
        n = self.index.n
        stop = self.from_[n] + np.cumsum(ends - starts)
        self.from_[n + 1 : n + 1 + len(pieces)] = stop
        self.head[:, n : n + len(pieces)] = _first_words(data, starts, ends - starts)
        if stop[-1] > len(self.bytes):
            self.bytes = np.resize(self.bytes, int(stop[-1]) * 2)
        self.bytes[self.from_[n] : stop[-1]] = np.frombuffer(b"".join(pieces), np.uint8)

    def _differ(self, data, starts, ends, at) -> np.ndarray:
        """Which chunks' bytes are not those of the entries found for them."""
        size, kept = ends - starts, self.from_[at + 1] - self.from_[at]
        one, two = _first_words(data, starts, size)
        wrong = (size != kept) | (one != self.head[0][at]) | (two != self.head[1][at])
        same = np.flatnonzero(~wrong & (size > 16))
        size = size[same]
        unlike = data[spread(starts[same], size)] != self.bytes[spread(self.from_[at[same]], size)]
        if unlike.any():
            wrong[same[np.repeat(np.arange(len(same)), size)[unlike]]] = True
        return np.flatnonzero(wrong)

    def _entries(self, data, starts, ends) -> np.ndarray:
        h = run_hashes(data, starts, ends)
        at = self.index.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            full = self.index.n + len(fresh) + len(h) // 8 > self.index.capacity  # with room for chunks that share a hash
            if self.index.n and (full or self.from_[self.index.n] + len(data) > CACHE_BYTES):
                self._reset()
                return self._entries(data, starts, ends)
            if full:
                while len(fresh) * 2 + len(h) // 8 > self.index.capacity:  # one huge text; a larger table for it
                    self.index = HashIndex(self.index.bits + 1)
                self._reset()
            self._keep(data, starts[first], ends[first])
            at[new] = self.index.add(fresh)[back]
        wrong = self._differ(data, starts, ends, at)
        if len(wrong):  # other bytes with the same hash: entries of their own, which no hash leads to
            if self.index.n + len(wrong) > self.index.capacity:
                self.index = HashIndex(self.index.bits + 1)
                self._reset()
                return self._entries(data, starts, ends)
            self._keep(data, starts[wrong], ends[wrong])
            at[wrong] = np.arange(self.index.n, self.index.n + len(wrong))
            self.index.n += len(wrong)
        return at


class HFTokenizer(_Chunked):
    """A file of the ``tokenizers`` library.  ``cut`` is "space" (byte-level, a space
    starts a chunk) or "blank" (white space is dropped and only separates)."""

    def __init__(self, path: str, cut: str = "space", bits: int = 22) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cut = Tokenizer.from_file(path), cut
        super().__init__(bits)

    def _reset(self) -> None:
        super()._reset()
        self.begin = np.zeros(self.index.capacity + 1, np.int64)
        self.flat = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def _chunks(self, data, offsets):
        if not len(data):
            z = np.zeros(0, np.int64)
            return z, z, z
        # A letter and a following stop or line end are always two pre-tokens.
        letter, stop = _LETTER[data], _STOP[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = letter[:-1] & stop[1:]
        text_start = np.zeros(len(data) + 1, bool)
        text_start[offsets] = True
        if self.cut == "blank":
            blank = _LINE[data]
            inside = ~blank
            cut[1:] |= (blank[:-1] & inside[1:]) | (stop[:-1] & letter[1:])
            cut |= text_start[:-1]
            cut &= inside
            starts = np.flatnonzero(cut)
            close = np.zeros(len(data) + 1, bool)
            close[1:-1] = inside[:-1] & (cut[1:] | blank[1:])
            close[-1] = inside[-1]
            close[1:] |= text_start[1:] & inside
            ends = np.flatnonzero(close)
        else:
            line = data == 10
            cut[1:] |= (letter | stop)[:-1] & line[1:]
            cut[2:] |= line[1:-1] & letter[2:] & (letter | stop)[:-2]
            cut[:-1] |= _BLANK[data[:-1]] & ~_UNSURE[data[1:]] & ~text_start[1:-1]
            cut |= text_start[:-1]
            starts = np.flatnonzero(cut)
            ends = np.r_[starts[1:], len(data)]
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def _store(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 20_000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(chunks[i : i + 20_000], add_special_tokens=False)]
            n = self.index.n + i
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            end = self.begin[n] + np.cumsum(lengths)
            self.begin[n + 1 : n + 1 + len(lists)] = end
            if end[-1] > len(self.flat):
                self.flat = np.resize(self.flat, int(end[-1]) * 2)
            self.flat[self.begin[n] : end[-1]] = np.fromiter(chain.from_iterable(lists), self.flat.dtype, int(lengths.sum()))

    def ids(self, texts) -> list[np.ndarray]:
        """The ids of every text of an Arrow string array."""
        out: list[np.ndarray] = []
        for _, data, offsets in slices(texts):
            if self.cut == "blank" and b"<|" not in data.tobytes():
                data = _LOWER[data]  # these files lower-case; their special strings are matched before
            starts, ends, rows = self._chunks(data, offsets)
            at = self._entries(data, starts, ends)
            lengths = self.begin[at + 1] - self.begin[at]
            flat = self.flat[spread(self.begin[at], lengths)]
            bounds = np.r_[0, np.cumsum(lengths)][np.searchsorted(rows, np.arange(len(offsets)), "left")]
            out += [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out


class PieceCounter(_Chunked):
    """Token counts of a sentencepiece BPE model whose pieces hold spaces only at their start."""

    def __init__(self, path: str, bits: int = 22) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)
        super().__init__(bits)

    def _reset(self) -> None:
        super()._reset()
        self.count = np.zeros(self.index.capacity, np.int32)

    def _store(self, chunks: list[str]) -> None:
        n = self.index.n
        self.count[n : n + len(chunks)] = [len(x) for x in self.model.encode(chunks, num_threads=1)]

    def counts(self, texts) -> np.ndarray:
        """Tokens of every text of an Arrow string array."""
        out = np.zeros(len(texts), np.int64)
        for row, data, offsets in slices(texts):
            n = len(offsets) - 1
            starts, ends, rows = runs(data, offsets, _BLANK)
            at = self._entries(data, starts, ends)
            out[row : row + n] = np.bincount(rows, weights=self.count[at], minlength=n)
            # Doubled or outer spaces and the space symbol itself: the library sees such texts whole.
            blank = np.r_[0, np.cumsum(_BLANK[data])]
            odd = np.diff(offsets) > 0
            odd &= (blank[offsets[1:]] - blank[offsets[:-1]] + 1 != np.bincount(rows, minlength=n)) | (not self.separable)
            odd |= np.isin(np.arange(n), self._with_symbol(data, offsets))
            for i in np.flatnonzero(odd):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                out[row + i] = len(self.model.encode(text))
        return out

    @staticmethod
    def _with_symbol(data, offsets) -> np.ndarray:
        at = np.flatnonzero(data == 0x96)
        at = at[(at > 0) & (at + 1 < len(data))]
        at = at[(data[at - 1] == 0xE2) & (data[at + 1] == 0x81)]
        return np.searchsorted(offsets, at, "right") - 1


def load(kind: type, path: str, *args):
    """One instance of each tokenizer in a Python worker."""
    key = (kind, path, *args)
    if key not in _loaded:
        _loaded[key] = kind(path, *args)
    return _loaded[key]
