"""Words of whole texts as flat arrays: places and 64-bit hashes, without an object per word.

A word is a longest run of bytes other than space and 0x09 to 0x0D.  Its hash is a polynomial
in its bytes modulo 2**64, mixed afterwards; hashes of word windows are polynomials in the
word hashes, so that any window's hash is the difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        p = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[: n + 1]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents: document i has words first[i] to first[i+1]."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 places between its values."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, places, data = column.buffers()
    at = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words of each text of a string column; nulls have none."""
    data, at = buffers(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(at), np.int64))
    if lower:
        data = LOWER[data]
    inside = ~WHITE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    p = powers(BYTE_BASE, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    back = powers(inverse(BYTE_BASE), n)
    h = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, h, np.searchsorted(start, at))


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each (a longer text is a range of its own)."""
    _, at = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Prefix:
    """Prefix sums from which any window's hash follows."""

    total: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, base: int) -> "Prefix":
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * powers(base, len(h))[: len(h)], out=total[1:])
        return cls(total, powers(inverse(base), len(h)))

    def window(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start])
