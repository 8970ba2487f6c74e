"""Rolling digests of token sequences and content-defined sampling of their positions, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the two polynomial digests.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 15)
        with np.errstate(over="ignore"):
            known = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(b))))) for b in (base, pow(base, -1, 1 << 64)))
        _powers[base] = known
    return known[0][:n], known[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Digests of all slices of one token sequence (uint64 tokens that are well mixed)."""

    def __init__(self, tokens: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(tokens) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(tokens * up[:-1])))

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (np.asarray(ends) - np.asarray(starts)).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        later, later_at = best[step:], at[step:]
        best, at = best[: len(later)], at[: len(later)]
        take = later < best
        best, at = np.where(take, later, best), np.where(take, later_at, at)
        span += step
    return at[:n]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(ends, n), -1)
    return np.cumsum(marks[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
