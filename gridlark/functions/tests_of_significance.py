"""Tail probabilities in numpy, from published formulas; the columns around them live in operators.trends."""

from __future__ import annotations

from functools import lru_cache
from math import erfc, exp, lgamma, log, log1p, sqrt

import numpy as np


def normal_two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


@lru_cache(maxsize=64)
def inversions(n: int) -> tuple[int, ...]:
    """Number of permutations of n with k inversions, for each k."""
    counts = np.array([1], dtype=object)
    for size in range(2, n + 1):
        counts = np.convolve(counts, np.ones(size, dtype=object))
    return tuple(counts)


def kendall_two_sided(s: float, n: int, x_ties: list[int], y_ties: list[int], exact_up_to: int = 33) -> float:
    """p of Kendall's S: exact without ties up to a number of points, else normal with tie-corrected variance."""
    if n < 2:
        return float("nan")
    pairs = n * (n - 1) // 2
    if not x_ties and not y_ties and (n <= exact_up_to or min((pairs - s) / 2, (pairs + s) / 2) <= 1):
        down = int(round((pairs - abs(s)) / 2))
        total = sum(inversions(n))
        return float(min(1.0, 2 * sum(inversions(n)[: down + 1]) / total))
    f = lambda ts, g: sum(g(t) for t in ts)
    v0 = n * (n - 1) * (2 * n + 5)
    vt, vu = (f(ts, lambda t: t * (t - 1) * (2 * t + 5)) for ts in (x_ties, y_ties))
    v1 = f(x_ties, lambda t: t * (t - 1)) * f(y_ties, lambda t: t * (t - 1)) / (2 * n * (n - 1))
    v2 = f(x_ties, lambda t: t * (t - 1) * (t - 2)) * f(y_ties, lambda t: t * (t - 1) * (t - 2)) / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0
    var = (v0 - vt - vu) / 18 + v1 + v2
    return normal_two_sided(s / sqrt(var)) if var > 0 else float("nan")


def sen_bounds(n: int, n_slopes: int, x_ties: list[int], y_ties: list[int], z: float = 1.959963984540054) -> tuple[int, int]:
    """Places (from 0) of the 95 % bounds among the sorted pair slopes, after Sen (1968)."""
    ties = sum(t * (t - 1) * (2 * t + 5) for t in (*x_ties, *y_ties))
    sigma = sqrt(max(0.0, (n * (n - 1) * (2 * n + 5) - ties) / 18))
    low, high = int(round((n_slopes - z * sigma) / 2)), int(round((n_slopes + z * sigma) / 2)) - 1
    return max(low, 0), min(high, n_slopes - 1)
