"""Null distributions of rank tests without ties, counted out."""

from __future__ import annotations

from functools import cache

import numpy as np


@cache
def signed_rank_counts(n: int) -> np.ndarray:
    """In how many of the 2 ** n choices of signs the positive ranks 1 to n sum to each value."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    return ways


@cache
def rank_sum_counts(n: int, m: int) -> np.ndarray:
    """In how many of the choices of n places among n + m each value of U occurs: a product of (1 - q ** (m + i)) / (1 - q ** i)."""
    n, m = min(n, m), max(n, m)
    ways = np.zeros(n * m + 1)
    ways[0] = 1
    for i in range(1, n + 1):
        ways[m + i :] -= ways[: -(m + i)].copy() if m + i < len(ways) else 0
        for start in range(i):  # divided by 1 - q ** i: sums along each residue
            ways[start::i] = np.cumsum(ways[start::i])
    return ways


def tails(ways: np.ndarray, value: int) -> tuple[float, float]:
    """P(X <= value) and P(X >= value)."""
    total = ways.sum()
    return float(ways[: value + 1].sum() / total), float(ways[value:].sum() / total)
