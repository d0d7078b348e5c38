"""Quantiles of the chi-squared distribution, without scipy."""

from __future__ import annotations

import math


def chi2_cdf(x: float, k: int) -> float:
    """The regularised lower incomplete gamma function P(k/2, x/2)."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return front * total
    # Continued fraction of the upper tail, evaluated by Lentz's rule.
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, k: int) -> float:
    """The x below which a chi-squared variable of k degrees of freedom lies with probability p."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    lo, hi = 0.0, max(1.0, float(k))
    while chi2_cdf(hi, k) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2
