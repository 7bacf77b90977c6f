"""Vectorised word splitting and hashing over Arrow string columns.

Everything works on the raw UTF-8 buffer of a column, so no Python object is
made per document or per word.  Word classes used by the operators are defined
on bytes; multi-byte characters are covered because all their bytes are >= 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once by the numpy code; bounds a worker's memory.
CHUNK_BYTES = 2 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Digits, letters (after lower-casing) and every non-ASCII byte.
ALNUM = _class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but ASCII white space.
NONSPACE = ~_class((0x09, 0x0D), (0x20, 0x20))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers = np.ones(size, np.uint64)
        _inverse = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            _powers[1:] = np.multiply.accumulate(np.full(size - 1, _MULT, np.uint64))
            _inverse[1:] = np.multiply.accumulate(np.full(size - 1, _INV, np.uint64))
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or binary or pa.types.is_string(column.type)):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one row."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a run of documents: start, end (bytes), hash and document index of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
        self.data = data = LOWER[data] if lower else data
        self.offsets, self.docs = offsets, len(offsets) - 1
        n = len(data)
        if n:
            mask = inside[data]
            change = np.empty(n + 1, bool)
            change[0], change[n] = mask[0], mask[-1]
            np.not_equal(mask[1:], mask[:-1], out=change[1:n])
            # a word also ends where a document ends
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            cut = cut[mask[cut] & mask[cut - 1]]
            edges = np.flatnonzero(change)
            if len(cut):
                edges = np.sort(np.concatenate([edges, np.repeat(np.unique(cut), 2)]))
            self.start, self.end = edges[0::2], edges[1::2]
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)  # index of each document's first word
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        power, inverse = _pow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        terms = _TABLE[self.data]
        terms *= power[:n]
        np.cumsum(terms, out=total[1:])
        # the length keeps apart words that differ in zero terms only
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.count)


def sums(values: np.ndarray, first: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=total[1:], dtype=dtype)
    return total[first[1:]] - total[first[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and the first window of each document.

    A document of fewer words, but not none, has one window of all its words.
    """
    count = np.diff(first)
    power = np.array([pow(_MULT, 3 * k + 1, 1 << 64) for k in range(width)], np.uint64)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        rolled[: n - k] += hashes[k:] * power[k]
    inside = np.arange(n) - np.repeat(first[:-1], count)
    keep = inside <= np.repeat(count - width, count)
    for i in np.flatnonzero((count > 0) & (count < width)):
        keep[first[i]] = True
        with np.errstate(over="ignore"):
            rolled[first[i]] = (hashes[first[i] : first[i + 1]] * power[: count[i]]).sum(dtype=np.uint64) + np.uint64(count[i])
    per = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    return mix(rolled[keep]), np.concatenate([[0], np.cumsum(per)])
