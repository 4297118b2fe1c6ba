"""Vectorised word hashing over Arrow string columns.

Texts of a batch are viewed as one byte buffer. A prefix sum of ``byte * B**i`` modulo 2**64 gives the
polynomial hash of any byte range in O(1), so words, and runs of words, are hashed without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: bijective, every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_powers: dict[str, np.ndarray] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            with np.errstate(over="ignore"):
                table = np.full(size, base, U64)
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``out[i]`` = sum of ``values[j] * B**j`` for j < i, modulo 2**64."""
    up, _ = _pow_tables(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges [start, end); equal ranges hash alike wherever they stand."""
    _, down = _pow_tables(len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


#: Byte classes: white space is 0. ``RAW`` keeps all other bytes, ``FOLDED`` lowers ASCII letters and drops ASCII punctuation.
RAW = np.arange(256, dtype=np.uint8)
RAW[[9, 10, 11, 12, 13, 32]] = 0
FOLDED = RAW.copy()
for _b in range(128):
    _c = chr(_b)
    FOLDED[_b] = ord(_c.lower()) if _c.isalnum() else 0
#: Shapes: capitals, small letters, digits, bytes of other scripts; punctuation stays as it is.
SHAPE = RAW.copy()
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[128:] = ord("a")


@dataclass
class Words:
    """Words of several texts: byte ranges in ``data`` and, for text i, the words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, classes: np.ndarray = RAW) -> np.ndarray:
        return range_hashes(prefix_sums(classes[self.data].astype(U64)), self.start, self.end)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(data: np.ndarray, begin: np.ndarray, classes: np.ndarray = RAW) -> Words:
    """Maximal runs of bytes whose class isn't 0; a word never spans two texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = classes[data] != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(data, begin, start, end, np.searchsorted(start, begin))


def slices(column: pa.Array | pa.ChunkedArray, most: int = _SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a column into runs of whole texts of about ``most`` bytes: (index of the first text, bytes, offsets)."""
    data, begin = buffers(column)
    i, n = 0, len(begin) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, data[begin[i] : begin[j]], begin[i : j + 1] - begin[i]
        i = j


def run_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that lie in one text, and where each begins."""
    if len(words) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.arange(len(words) - k + 1)
    text_end = np.repeat(first[1:], np.diff(first))
    at = at[at + k <= text_end[at]]
    return range_hashes(prefix_sums(words), at, at + k), at
