"""Hashes of words and word sequences for many texts at once, on their UTF-8 bytes.

Bytes are drawn to fixed random numbers and summed with powers of an odd factor, so the hash of any
stretch is the difference of two running sums, and equal stretches have equal hashes wherever they
stand. All arithmetic is modulo 2^64, followed by a mixing step.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_UPPER = np.arange(256)
LOWERED = np.where((_UPPER >= 0x41) & (_UPPER <= 0x5A), _UPPER + 32, _UPPER).astype(np.uint8)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(9, 14)]] = True
KEPT_POWERS = 1 << 21
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); kept for usual slices, as each of them needs it."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Texts:
    """UTF-8 of many texts in a row, cut into stretches."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lowered: bool = False):
        self.data = LOWERED[data] if lowered else data
        self.offsets = offsets
        self._sums: np.ndarray | None = None

    def stretches(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each longest run without separators (a table of 256 flags) within a text."""
        inside = ~separator[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTES[self.data] * _power(_FACTOR, n), out=self._sums[1:])
        raw = (self._sums[ends] - self._sums[starts]) * _power(_INVERSE, len(self.data) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n hashes in a row (shorter by n - 1 than the input)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * _U(_FACTOR) + hashes[k:k + m]
    return mix(total)


def first_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For sorted places, the index of the first one in each text; the last entry is their number."""
    return np.searchsorted(starts, offsets)
