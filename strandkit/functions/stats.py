"""Tail probabilities for aggregated statistics (one row per group)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for step in range(0, 400):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def t_two_sided(rho: float, n: int) -> float:
    """Two-sided p value of a correlation through Student's t with n - 2 degrees."""
    if rho is None or math.isnan(rho) or n < 3:
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    df = n - 2
    t2 = rho * rho * df / (1.0 - rho * rho)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t2))


def spearman_p_value(rho: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(float(a), int(b)) if a == a else None for a, b in zip(r, k)])

    return p_value(rho.cast("double"), n.cast("long"))
