"""Distribution functions that Spark lacks, in plain Python."""

from __future__ import annotations

import math


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by a continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def student_cdf(t: float, n: float) -> float:
    tail = betainc(n / 2, 0.5, n / (n + t * t)) / 2
    return 1 - tail if t > 0 else tail


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of Pearson's r."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    return 2 * (1 - student_cdf(t, n - 2))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def poisson_cdf(k: int, mean: float) -> float:
    """P(X <= k)."""
    if k < 0:
        return 0.0
    if mean <= 0:
        return 1.0
    total = term = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return min(1.0, total)


def kendall(x, y) -> float:
    """Kendall's tau-b; NaN if either is constant."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    up = np.triu_indices(len(x), 1)
    a, b = dx[up], dy[up]
    den = math.sqrt((a != 0).sum() * (b != 0).sum())
    return float((a * b).sum() / den) if den else float("nan")
