"""Vectorised text kernels over Arrow string columns.

Each kernel works on the UTF-8 bytes of a slice of rows at once, so the cost of a word is a few numpy passes and no
Python object is made for it. Slices hold about ``SLICE`` bytes (one text at least), which bounds the memory of a task
whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space ends: everything but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes of the words of lower-cased text: digits, a-z and all bytes of characters beyond ASCII.
ALNUM = np.ones(256, dtype=bool)
ALNUM[:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def randoms(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants, the same on every machine."""
    return mix((np.arange(n, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_places = randoms(11, 256)


def _place_constants(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = randoms(11, 1 << int(n - 1).bit_length())
    return _places


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    held = column.buffers()[1]
    offsets = np.frombuffer(held, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if held else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


class Words:
    """Words of a slice of rows: where they start and end, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data, self.inside = data, kind[data]
        first, last = self.inside.copy(), self.inside.copy()
        first[1:] &= ~self.inside[:-1]
        last[:-1] &= ~self.inside[1:]
        full = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        first[heads], last[tails] = self.inside[heads], self.inside[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.rows)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        return hash_words(self.data[self.inside], self.ends - self.starts)


def hash_words(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that stand one behind the other in ``data``."""
    if not len(lengths):
        return np.zeros(0, U64)
    to = np.cumsum(lengths)
    place = np.arange(to[-1]) - np.repeat(to - lengths, lengths)
    terms = _place_constants(int(lengths.max()))[place]
    terms *= data.astype(U64) + U64(1)
    return mix(np.add.reduceat(terms, to - lengths) ^ (lengths.astype(U64) * U64(0x9E3779B97F4A7C15)))


_gram = randoms(23, 64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n neighbours, across row borders: the caller drops those that cross one."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = h[: len(h) - n + 1] * _gram[0]
    for k in range(1, n):
        out += h[k : len(h) - n + 1 + k] * _gram[k]
    return mix(out ^ U64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each row, lower-cased; a row of fewer words has its whole sequence as one."""
    w = Words(LOWER[data], offsets, SPACED)
    h = w.hashes()
    g = grams(h, n)
    out = []
    for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(grams(h[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a value of each byte or word by row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
