"""Vectorised text kernel: numpy over the contiguous UTF-8 buffer of an Arrow string column.

No function here loops over bytes or words in Python. A column is cut into slices of a few MB, so memory is bounded by
``SLICE_BYTES`` (or by one document, if a single one is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random 64-bit value per byte, and powers of an odd base by the position in a word.
BYTE_VALUES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

#: Space and \\x09 to \\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(1, n), _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


def give_back() -> None:
    """Returns what a worker no longer uses to the system, as workers of one machine share its memory and outlive their tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets into them) of consecutive slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        high = min(high, n)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
    give_back()


def words(raw: np.ndarray, at: np.ndarray, lower: bool = True, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, row) of every word: a maximal run of bytes that aren't in ``space``, within one row."""
    inside = ~space[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, starts)
    length = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, length)
    b = raw[where]
    value = BYTE_VALUES[LOWER[b] if lower else b] * _powers(int(length.max()))[place]
    h = mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _PLACE[0])
    row = np.searchsorted(at, starts, "right") - 1
    return h, starts, starts + length, row


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle; of a row with fewer words its whole sequence counts as one."""
    if not len(h):
        return h, row
    n = len(h)
    spread = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        spread += h[j : n - k + 1 + j] * _PLACE[8 + j]
    whole = row[: n - k + 1] == row[k - 1 :] if n >= k else np.zeros(0, bool)
    s, r = mix(spread[whole]), row[: n - k + 1][whole] if n >= k else row[:0]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(row, short)
        total = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            more = count[short] > j
            total[more] += h[first[more] + j] * _PLACE[8 + j]
        s, r = np.concatenate([s, mix(total + _PLACE[40 + count[short]])]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        s, r = s[order], r[order]
    return s, r


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes), in order, for every row."""
    for low, high, raw, at in slices(column):
        h, _, _, row = words(raw, at)
        s, r = shingles(h, row, high - low, k)
        edge = np.searchsorted(r, np.arange(high - low + 1))
        for i in range(high - low):
            x = s[edge[i] : edge[i + 1]]
            if len(x) > 1:
                x = np.sort(x)
                x = x[np.append(True, x[1:] != x[:-1])]
            yield low + i, x
