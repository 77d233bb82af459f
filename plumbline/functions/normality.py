"""Normality from moments (any size) and from at most 5000 sorted values."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def k2_pvalue(n: Column, skew: Column, kurtosis: Column) -> Column:
    """D'Agostino-Pearson omnibus p-value from count, population skew and excess kurtosis."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    z_skew = delta * F.asinh(y / alpha)
    expect = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurtosis + 3 - expect) / F.sqrt(spread)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    z_kurt = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return F.exp(-(z_skew * z_skew + z_kurt * z_kurt) / 2)


def shapiro_pvalue(values: list[float]) -> float:
    """Shapiro-Wilk p-value by Royston's 1995 approximation, for 3 to 5000 values."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 0.0 if n < 3 else 1.0
    normal = NormalDist()
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm = sum(v * v for v in m)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        u = 1 / math.sqrt(n)

        def poly(coefs: list[float], at: float) -> float:
            return sum(c * at**i for i, c in enumerate(coefs))

        # Royston's published polynomial coefficients.
        last = poly([0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], u) + m[-1] / math.sqrt(mm)
        second = poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u) + m[-2] / math.sqrt(mm)
        if n <= 5:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *[v / math.sqrt(phi) for v in m[1:-1]], last]
        else:
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *[v / math.sqrt(phi) for v in m[2:-2]], second, last]
    mean = sum(x) / n
    w = sum(c * v for c, v in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)
    w = min(w, 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return min(max(p, 0.0), 1.0)
    if w >= 1.0:
        return 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if gamma <= math.log(1 - w):
            return 0.0
        stat = -math.log(gamma - math.log(1 - w))
        mu = 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        log_n = math.log(n)
        stat = math.log(1 - w)
        mu = -1.5861 - 0.31082 * log_n - 0.083751 * log_n**2 + 0.0038915 * log_n**3
        sigma = math.exp(-0.4803 - 0.082676 * log_n + 0.0030302 * log_n**2)
    return 1 - normal.cdf((stat - mu) / sigma)
