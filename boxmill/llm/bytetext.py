"""Arrow text columns as flat byte arrays, and hashes of their words.

All rows of a slice are handled together: one byte array, with the start and the end of each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no visible order."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _ODD)


_BYTE = _numbers(256, 1)
_BASE = _numbers(1, 2)[0] | _U(1)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))

# fixed values: white space between words is 0x20 and 0x09 to 0x0D; A to Z are lowered, nothing else
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each row, end of each row) of a text column; a NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` text bytes; a longer row is a piece of its own."""
    _, start, end = flat(batch.column(batch.schema.get_field_index(text)))
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(end, start[low] + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word never goes over the end of its row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[start[start < end]] = True
    edge[-1] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, stop, np.searchsorted(start, begin, "right") - 1


def word_hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, by differences of one running sum over all bytes."""
    n = len(data)
    if not n or not len(begin):
        return np.zeros(len(begin), _U)
    up = np.full(n, _BASE, _U)
    up[0] = 1
    np.cumprod(up, out=up)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[LOWER[data] if lower else data] * up, out=total[1:])
    down = np.full(n, _BACK, _U)
    down[0] = 1
    np.cumprod(down, out=down)
    return mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(_U) * _ODD)


def shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all word shingles in row order; a row of fewer words has them all as one."""
    begin, stop, row = words(data, start, end)
    n = np.bincount(row, minlength=len(start))
    code = word_hashes(data, begin, stop)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    place = np.arange(len(row)) - first[row]
    size = n[row]
    heads = np.flatnonzero((place <= size - width) | (place == 0))
    length = np.minimum(size[heads], width)
    step, total = _numbers(width, 3) | _U(1), length.astype(_U) * _ODD
    for k in range(width):
        has = length > k
        total[has] += code[heads[has] + k] * step[k]
    return mix(total), row[heads]
