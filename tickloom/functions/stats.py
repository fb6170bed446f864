"""Statistical aggregates that are safe under ANSI mode, and the F-test tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def pair_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values; NULL for a constant side.

    The built-in ``corr`` divides by zero on a constant column.
    """
    x_both = F.when(y.isNotNull(), x)
    y_both = F.when(x.isNotNull(), y)
    scale = F.stddev_samp(x_both) * F.stddev_samp(y_both)
    return F.try_divide(F.covar_samp(x, y), scale)


def weighted_corr(x: Column, y: Column, weight: Column) -> Column:
    """Correlation of rows repeated ``weight`` times; NULL for a constant side.

    Meant for ranks centred on zero, so the plain moment sums stay accurate.
    """
    n = F.sum(weight)
    mean_x, mean_y = F.sum(x * weight) / n, F.sum(y * weight) / n
    cov = F.sum(x * y * weight) / n - mean_x * mean_y
    var_x = F.sum(x * x * weight) / n - mean_x * mean_x
    var_y = F.sum(y * y * weight) / n - mean_y * mean_y
    return F.try_divide(cov, F.sqrt(F.greatest(var_x, F.lit(0.0))) * F.sqrt(F.greatest(var_y, F.lit(0.0))))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Modified Lentz evaluation of the incomplete-beta continued fraction."""
    tiny, eps = 1e-300, 1e-15
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < eps:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def f_tail(f_value: float, df1: float, df2: float) -> float:
    """P(F > f_value) for an F distribution with df1 and df2 degrees of freedom."""
    if any(v is None or np.isnan(v) for v in (f_value, df1, df2)) or df1 <= 0 or df2 <= 0:
        return float("nan")
    if f_value <= 0:
        return 1.0
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f_value))


@F.pandas_udf(DoubleType())
def f_tail_udf(f_value: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(f, a, b) for f, a, b in zip(f_value, df1, df2)], dtype="float64")
