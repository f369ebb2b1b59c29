"""Tail probabilities of test statistics, over whole Arrow batches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov_tail(statistic: float, n: int, m: int) -> float:
    """Asymptotic probability of a two-sample Kolmogorov-Smirnov distance this large; 1 for fewer than two values."""
    if n < 2 or m < 2:
        return 1.0
    x = math.sqrt(n * m / (n + m)) * statistic
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(statistic: float, degrees: int) -> float:
    return 1.0 if degrees < 1 else gamma_tail(degrees / 2, statistic / 2)


@F.pandas_udf(T.DoubleType())
def ks_p(statistic, n, m):
    import pandas as pd

    return pd.Series([kolmogorov_tail(*x) for x in zip(statistic, n, m, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(statistic, degrees):
    import pandas as pd

    return pd.Series([chi2_tail(*x) for x in zip(statistic, degrees, strict=True)], dtype="float64")
