"""Least squares: autoregressive baselines and Granger causality tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.functions.stats import f_tail_udf
from tickloom.operators.evaluation import prediction_metrics
from tickloom.operators.features import complete_cases, present_columns
from tickloom.operators.pairs import PAIR_KEYS
from tickloom.settings import PAIR_LAGS, TARGET


def ols_predict(train: DataFrame, test: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """Fit on complete training rows (one pass, normal equations), predict test rows as ``p``."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    solver = LinearRegression(
        featuresCol="_features", labelCol=target, predictionCol="p", solver="normal", regParam=0.0, standardization=False
    )
    model = solver.fit(assembler.transform(complete_cases(train, features, target)))
    return model.transform(assembler.transform(complete_cases(test, features, target))).drop("_features")


def ar_baselines(dataset: DataFrame, orders: Sequence[int] = (1, 3, 6), target: str = TARGET) -> DataFrame:
    """Test metrics of AR(p): regress the target on those of lag1..lagp that exist."""
    train, test = (dataset.filter(F.col("split") == name) for name in ("train", "test"))
    scored = None
    for p in orders:
        features = present_columns(dataset, [f"lag{k}" for k in range(1, p + 1)])
        if not features or complete_cases(train, features, target).isEmpty():
            continue
        predicted = ols_predict(train, test, features, target).select(
            F.lit(f"AR({p})").alias("model"), F.col(target).alias("y"), "p"
        )
        scored = predicted if scored is None else scored.unionByName(predicted)
    if scored is None:
        raise ValueError("no lag columns or no complete training rows for an AR baseline")
    return prediction_metrics(scored, ["model"])


def _residual_sum(n: float, covariances: np.ndarray, size: int) -> float:
    """RSS of column 0 on the others and an intercept, from the upper triangle of covariances."""
    cov = np.zeros((size, size))
    cov[np.triu_indices(size)] = covariances
    cov = np.triu(cov) + np.triu(cov, 1).T
    beta = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
    return max(float(n * (cov[0, 0] - cov[1:, 0] @ beta)), 0.0)


_RESIDUAL_SUMS = StructType([StructField("rss_r", DoubleType()), StructField("rss_u", DoubleType())])


@F.pandas_udf(_RESIDUAL_SUMS)
def _residual_sums_udf(rn: pd.Series, rc: pd.Series, un: pd.Series, uc: pd.Series) -> pd.DataFrame:
    """Two small solves per aggregated row; no data rows get here."""

    def solved(counts: pd.Series, covariances: pd.Series) -> list[float | None]:
        sizes = ((math.isqrt(8 * len(c) + 1) - 1) // 2 for c in covariances)
        return [_residual_sum(n, np.asarray(c, float), size) if n else None for n, c, size in zip(counts, covariances, sizes)]

    return pd.DataFrame({"rss_r": solved(rn, rc), "rss_u": solved(un, uc)}, dtype="float64")


def _masked(prefix: str, names: Sequence[str]) -> list[Column]:
    """Copies of columns, all NULL where one of them is."""
    complete = F.lit(True)
    for name in names:
        complete = complete & F.col(name).isNotNull()
    return [F.when(complete, F.col(name)).alias(f"{prefix}{i}") for i, name in enumerate(names)]


def _moments(prefix: str, size: int) -> list[Column]:
    """Row count and the upper triangle of covariances of masked columns.

    The built-in covariance carries means along and merges centred sums, so one pass is enough
    however far the values are from zero.
    """
    c = [F.col(f"{prefix}{i}") for i in range(size)]
    covariances = F.array(*(F.covar_pop(c[i], c[j]) for i in range(size) for j in range(i, size)))
    return [F.count(c[0]).alias(f"{prefix}n"), covariances.alias(f"{prefix}c")]


def granger_tests(
    pairs_lagged: DataFrame,
    lags: Sequence[int] = PAIR_LAGS,
    intercept_in_df: bool = False,
) -> DataFrame:
    """F-test per (pair, direction): do the other side's lags help beyond own lags?

    All that regression needs are covariances, so every pair and both
    directions are one aggregation with map-side partials, in one read. The restricted and the
    unrestricted model each use their own complete rows, so their terms keep separate masks.
    ``df2 = n - k`` leaves the intercept out unless ``intercept_in_df`` is set.
    """
    lags = [k for k in lags if f"a_lag{k}" in pairs_lagged.columns]
    width = len(lags)

    def view(direction: str, cause: str, effect: str) -> Column:
        return F.struct(
            F.lit(direction).alias("direction"),
            F.col(f"{effect}_ofi_z").alias("y"),
            *(F.col(f"{effect}_lag{k}").alias(f"own{k}") for k in lags),
            *(F.col(f"{cause}_lag{k}").alias(f"other{k}") for k in lags),
        )

    own = ["y", *(f"own{k}" for k in lags)]
    both = [*own, *(f"other{k}" for k in lags)]
    views = pairs_lagged.select(
        *PAIR_KEYS, F.inline(F.array(view("a_to_b", "a", "b"), view("b_to_a", "b", "a")))
    )
    moments = (
        views.select(*PAIR_KEYS, "direction", *_masked("r", own), *_masked("u", both))
        .groupBy(*PAIR_KEYS, "direction")
        .agg(*_moments("r", len(own)), *_moments("u", len(both)))
    )
    solved = moments.select(
        *PAIR_KEYS,
        "direction",
        F.col("un").alias("n"),
        _residual_sums_udf("rn", "rc", "un", "uc").alias("rss"),
    ).select(*PAIR_KEYS, "direction", "n", "rss.*")
    df1 = F.lit(float(width))
    df2 = (F.col("n") - 2 * width - (1 if intercept_in_df else 0)).cast("double")
    # An exact fit leaves rounding noise instead of 0; its figures are NULL.
    fitted = F.col("rss_u") > 1e-12 * F.col("rss_r")
    statistic = ((F.col("rss_r") - F.col("rss_u")) / df1) / (F.col("rss_u") / df2)
    tested = solved.filter(df2 > 0).withColumn("f_statistic", F.when(fitted, statistic))
    p_value = f_tail_udf("f_statistic", df1, df2)
    return (
        tested.withColumn("p_value", p_value)
        .withColumn("significant_at_05", F.col("p_value") < 0.05)
        .withColumn("rss_reduction", F.when(fitted, F.try_divide(F.col("rss_r") - F.col("rss_u"), F.col("rss_r"))))
        .select(*PAIR_KEYS, "direction", "n", "f_statistic", "p_value", "significant_at_05", "rss_reduction")
    )
