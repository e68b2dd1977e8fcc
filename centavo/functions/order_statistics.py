"""Exact order statistics of many ranges of a weighted integer sequence at once."""

from __future__ import annotations

import numpy as np


class Ranges:
    """A wavelet matrix: ranks are compressed once, every bit of a rank is a level, and all queries go down the levels together.

    A value may stand for several equal ones (its weight). Memory is 16 bytes a value and level; a query costs one step a level."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.distinct, code = np.unique(values, return_inverse=True)
        self.total = np.r_[0, np.cumsum(weights)]
        self.levels = []
        for bit in reversed(range(max(1, len(self.distinct).bit_length()))):
            ones = (code >> bit) & 1 == 1
            zeros, weight = np.r_[0, np.cumsum(~ones)], np.r_[0, np.cumsum(np.where(ones, 0, weights))]
            self.levels.append((bit, zeros, weight, int(zeros[-1])))
            order = np.argsort(ones, kind="stable")
            code, weights = code[order], weights[order]

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0, by weight) among the places from left to before right."""
        found = np.zeros(len(k), np.int64)
        for bit, zeros, weight, n_zeros in self.levels:
            lower = weight[right] - weight[left]
            up = k >= lower
            k = np.where(up, k - lower, k)
            found |= up.astype(np.int64) << bit
            left, right = (np.where(up, n_zeros + at - zeros[at], zeros[at]) for at in (left, right))
        return self.distinct[np.minimum(found, len(self.distinct) - 1)]

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The weight of what is less than value among the places from left to before right."""
        code, out = np.searchsorted(self.distinct, value), np.zeros(len(value), np.int64)
        for bit, zeros, weight, n_zeros in self.levels:
            up = (code >> bit) & 1 == 1
            out += np.where(up, weight[right] - weight[left], 0)
            left, right = (np.where(up, n_zeros + at - zeros[at], zeros[at]) for at in (left, right))
        return out


def half_up(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The mean of two integers, halves away from zero."""
    both = low + high
    return (np.abs(both) + 1) // 2 * np.sign(both)


def robust(values: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    """Median, median absolute deviation and the medians of the lower and upper half of each range (none empty)."""
    held = Ranges(values, weights)
    n = held.total[right] - held.total[left]
    median = lambda start, size: half_up(held.kth(left, right, start + np.maximum(size - 1, 0) // 2), held.kth(left, right, start + np.minimum(size // 2, np.maximum(size - 1, 0))))
    half = n // 2
    middle = median(np.zeros_like(n), n)
    quartiles = {"lower": median(np.zeros_like(n), half), "upper": median(n - half, half)}
    for name in quartiles:
        quartiles[name] = np.where(half > 0, quartiles[name], 0)
    return {"count": n, "middle": middle, "mad": _deviation(held, left, right, n, middle), **quartiles}


def _deviation(held: Ranges, left: np.ndarray, right: np.ndarray, n: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Half-up median of the distances from middle: the smallest ones come from two sorted sides, split by binary search."""
    under = held.below(left, right, middle)
    k = (n - 1) // 2
    lo, hi = np.maximum(0, k + 1 - (n - under)), np.minimum(under, k + 1)  # how many of the k + 1 smallest lie below
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        a, b, u, m = left[live], right[live], under[live], middle[live]
        more = m - held.kth(a, b, u - 1 - mid) < held.kth(a, b, u + k[live] - mid) - m
        lo[live], hi[live] = np.where(more, mid + 1, lo[live]), np.where(more, hi[live], mid)
        live = live[lo[live] < hi[live]]
    other = k + 1 - lo
    side = lambda some, rank, sign, none: np.where(some, sign * (held.kth(left, right, np.where(some, rank, 0)) - middle), none)
    last = np.maximum(side(lo > 0, under - lo, -1, -1), side(other > 0, under + other - 1, 1, -1))
    most = np.iinfo(np.int64).max
    following = np.minimum(side(lo < under, under - 1 - lo, -1, most), side(under + other < n, under + other, 1, most))
    return half_up(last, np.where(n % 2 == 0, following, last))
