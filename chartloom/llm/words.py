"""Vectorised views of text batches: byte runs, their hashes, and a cache keyed by them.

A batch of texts is one UTF-8 buffer with offsets.  Runs (words, chunks) are
found and hashed with whole-array NumPy operations; no Python object is made
per word.  Run hashes are 64-bit polynomial hashes over randomised bytes with a
final avalanche; two runs are taken for equal when they agree in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are handled in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
            _inverses = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE, np.uint64)])


def slices(texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string array into (first row, bytes, offsets) slices; null texts are empty."""
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are not spaces."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~is_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.r_[inside[1:], False]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; never 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _grow(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _inverses[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) | np.uint64(1)


class HashIndex:
    """Open-addressing table from run hashes to consecutive entry numbers, all in NumPy."""

    def __init__(self, bits: int = 21) -> None:
        self.bits = bits
        self.capacity = (1 << bits) * 2 // 5
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers; -1 where a hash is not there."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == h, self.values[slot], -1)
        open_ = np.flatnonzero((found != h) & (found != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            at = slot[open_]
            found = self.keys[at]
            hit = found == h[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found != 0)]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Give new, distinct hashes the next entry numbers."""
        mask = (1 << self.bits) - 1
        numbers = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            places, who = np.unique(at[free], return_index=True)
            winners = left[free][who]
            self.keys[places] = h[winners]
            self.values[places] = numbers[winners]
            done = np.zeros(len(h), bool)
            done[winners] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & mask
        return numbers


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def segment_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
