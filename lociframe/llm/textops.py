"""Vectorised word and shingle hashing over Arrow batches.

A whole batch of texts is tokenised at once on its UTF-8 bytes: words are the
maximal runs of bytes a table marks as word bytes, and every word gets a 64-bit
rolling hash from one pair of prefix sums."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2B  # 3 modulo 8, so its powers repeat late
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Odd multipliers of the words at positions 0..7 of a shingle.
_PLACE = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0x9FB21C651E98DF25)

#: Bytes A-Z to a-z, all others unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def release() -> None:
    """Give freed memory back to the machine: workers live on between stages, and what their allocators keep adds up beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, that releases what it has freed at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same function over a group."""

    def tidied(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            release()

    return tidied


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_pow = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n + 1:
        _pow = _powers(_BASE, n), _powers(_BASE_INV, n)
    return _pow


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1 of them) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, max_bytes: int = 1 << 20):
    """Consecutive (start, stop) row ranges of at most max_bytes, one row at least:
    the working memory of a batch then does not depend on how long its texts are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield start, stop
        start = stop


class Words:
    """The words of every text of a batch: start and end bytes, hash, and counts per text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = NOT_SPACE):
        self.data = data = ASCII_LOWER[data]
        mask = is_word[data]
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        inner = offs[1:-1]
        inner = inner[inner < len(data)]
        first[inner] = mask[inner]  # a word never runs on into the next text
        last = mask.copy()
        last[:-1] &= ~mask[1:] | first[1:]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bound = np.searchsorted(self.start, offs)
        self.count = np.diff(self.bound)

    def _sums(self) -> np.ndarray:
        if not hasattr(self, "_held"):
            n = len(self.data)
            self._held = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power_tables(n)[0][:n], out=self._held[1:])
        return self._held

    def prefix_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end; equal bytes have equal hashes."""
        sums = self._sums()
        return mix((sums[end] - sums[start]) * _power_tables(len(self.data))[1][start])

    def hashes(self) -> np.ndarray:
        return self.prefix_hashes(self.start, self.end)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, case kept; equal bytes have equal hashes."""
    powers, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def grams(word_hash: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and how many each text has."""
    count = np.maximum(np.diff(bound) - (k - 1), 0)
    n = len(word_hash) - (k - 1)
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros_like(count)
    z = word_hash[:n] * _PLACE[0]
    for i in range(1, k):
        z += word_hash[i : n + i] * _PLACE[i]
    inside = np.zeros(n + 1, np.int64)
    has = count > 0
    np.add.at(inside, bound[:-1][has], 1)
    np.add.at(inside, bound[:-1][has] + count[has], -1)
    return mix(z[np.cumsum(inside[:n]) > 0]), count


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, and the bounds of each text.

    A text of fewer words has its whole sequence as one shingle; without words none."""
    h = words.hashes()
    z, count = grams(h, words.bound, k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = words.count[short] > i
            own[has] += h[words.bound[short[has]] + i] * _PLACE[i]
        own = mix(own + words.count[short].astype(np.uint64) * _SHORT, 0x51)
        at = np.cumsum(count)[short] - count[short]
        z = np.insert(z, at, own)
        count = count.copy()
        count[short] = 1
    bound = np.concatenate([[0], np.cumsum(count)])
    for s, e in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if e - s > 1:
            z[s:e].sort()
    keep = np.ones(len(z), bool)
    keep[1:] = z[1:] != z[:-1]
    keep[bound[:-1][count > 0]] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return z[keep], sums[bound]
