"""Scores of predictions, profiles of datasets and comparison of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalar as fn
from tickloom.functions.stats import safe_corr, weighted_corr
from tickloom.operators.ordered import centred_ranks, cumulative_counts, join_on_keys, quantiles_of
from tickloom.settings import FEATURES, TARGET, materialize

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}

# Whether a smaller value of a metric wins.
METRICS = {"mse": True, "mae": True, "correlation": False, "directional_accuracy": False}


def metric_columns(y: Column, p: Column) -> list[Column]:
    """MSE, MAE, correlation, directional accuracy over non-zero pairs, and n.

    Rows with a missing or NaN side do not count; with no rows left all are NULL.
    """
    y, p = fn.nan_to_null(y), fn.nan_to_null(p)
    error = y - p
    directional = (y != 0) & (p != 0)
    return [
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        safe_corr(y, p).alias("correlation"),
        F.avg(F.when(directional, (F.signum(y) == F.signum(p)).cast("double"))).alias("directional_accuracy"),
        F.count(error).alias("n_samples"),
    ]


def prediction_metrics(predictions: DataFrame, group: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    return predictions.groupBy(*group).agg(*metric_columns(F.col(y), F.col(p)))


def rank_ic(
    predictions: DataFrame,
    group: Sequence[str],
    y: str = "y",
    p: str = "p",
    pieces: int | None = None,
) -> DataFrame:
    """Spearman correlation per group, tie-averaged ranks, 0 where undefined.

    The predictions are read once and become counts of distinct (y, p) pairs. Both sides are
    ranked in one pass, and ranks (less their mean) join back on the value.
    """
    group = list(group)
    # Zero of either sign is one value, as in comparisons.
    sides = [(fn.nan_to_null(F.col(c)) + F.lit(0.0)).alias(name) for c, name in ((y, "_y"), (p, "_p"))]
    clean = predictions.select(*group, *sides).dropna(subset=["_y", "_p"])
    weighted = materialize(clean.groupBy(*group, "_y", "_p").agg(F.count(F.lit(1)).alias("_w")), "value-pairs")
    entries = F.array(*(F.struct(F.lit(c).alias("_side"), F.col(c).alias("_value")) for c in ("_y", "_p")))
    values = weighted.select(*group, "_w", F.inline(entries)).groupBy(*group, "_side", "_value").agg(F.sum("_w").alias("n"))
    ranks = centred_ranks(values, [*group, "_side"], "_value", pieces)
    for c, name in (("_y", "_ry"), ("_p", "_rp")):
        side = ranks.filter(F.col("_side") == c).select(*group, F.col("_value").alias(c), F.col("rank").alias(name))
        weighted = join_on_keys(weighted, side, [*group, c])
    ic = F.coalesce(weighted_corr(F.col("_ry"), F.col("_rp"), F.col("_w").cast("double")), F.lit(0.0))
    return weighted.groupBy(*group).agg(ic.alias("information_coefficient"))


def describe_columns(df: DataFrame, columns: Sequence[str], pieces: int | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row per column.

    The frame is read once; everything follows from its counted values.
    """
    entries = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))
    long = df.select(F.inline(entries)).withColumn("value", fn.nan_to_null(F.col("value")))
    counted = materialize(cumulative_counts(long, ["column_name"], "value", pieces), "counted-values")
    n, value = F.col("n"), F.col("value")
    basic = counted.groupBy("column_name").agg(
        F.sum(n).alias("count"), (F.sum(n * value) / F.sum(n)).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    apart = value - F.col("mean")
    spread = counted.join(basic.select("column_name", "mean"), "column_name").groupBy("column_name")
    spread = spread.agg(F.sqrt(F.try_divide(F.sum(n * apart * apart), F.sum(n) - 1)).alias("std"))
    quartiles = quantiles_of(counted, ["column_name"], "value", QUARTILES)
    # A column without values keeps its row.
    names = df.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(columns)], "column_name string")
    for part in (basic, spread, quartiles):
        names = names.join(part, "column_name", "left")
    return names.withColumn("count", F.coalesce("count", F.lit(0))).select("column_name", "count", "mean", "std", "min", *QUARTILES, "max")


def dataset_profile(dataset: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """Rows, complete rows and date range per (symbol, split)."""
    complete = F.lit(True)
    for column in [*features, target]:
        complete = complete & F.col(column).isNotNull()
    return dataset.groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(complete).alias("n_valid"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def best_models(metrics: DataFrame, order: str = "ord", model: str = "model") -> DataFrame:
    """Winner per metric: smallest error, largest correlation or accuracy.

    Missing values never win. Equal values go to the first model in ``order``.
    """
    entries = F.array(
        *(
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).alias("value"),
                (F.col(name) if smaller else -F.col(name)).alias("loss"),
            )
            for name, smaller in METRICS.items()
        )
    )
    long = metrics.select(model, order, F.inline(entries)).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rank = F.struct("loss", order)
    return long.groupBy("metric").agg(F.min_by(model, rank).alias("best"), F.min_by("value", rank).alias("value"))


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Metrics as report text: upper-case model, fixed decimals, percent."""
    return metrics.select(
        F.upper("model").alias("model"),
        fn.fixed_decimals(F.col("mse"), 6).alias("mse"),
        fn.fixed_decimals(F.col("mae"), 6).alias("mae"),
        fn.fixed_decimals(F.col("correlation"), 4).alias("correlation"),
        fn.percent_text(F.col("directional_accuracy")).alias("directional_acc"),
        F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
    )


def metric_records(
    scores: DataFrame,
    params: Mapping[str, object] | None = None,
    importance: Mapping[str, float] | None = None,
) -> DataFrame:
    """Scores per (model, split) as one nested record per model, ready for the JSON sink."""
    block = F.struct("mse", "mae", "correlation", "directional_accuracy", "n_samples")
    splits = {"train": "train", "val": "validation", "test": "test"}
    weights = F.lit(None) if importance is None else F.create_map(*(F.lit(x) for item in importance.items() for x in item))
    return scores.groupBy("model").agg(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        constant_map(params or {}).alias("params"),
        weights.cast("map<string,double>").alias("feature_importance"),
        *(F.max(F.when(F.col("split") == label, block)).alias(name) for label, name in splits.items()),
    )


def importance_rows(records: DataFrame) -> DataFrame:
    """Feature importances of metric records, largest first within a model."""
    exploded = records.select("model", F.explode("feature_importance").alias("feature", "importance"))
    return exploded.orderBy("model", F.desc("importance"), "feature")


def model_report(records: DataFrame) -> DataFrame:
    """Per model: timestamp, parameters, best epoch and last losses."""

    def last(history: str) -> Column:
        values = F.col(f"history.{history}")
        return F.when(F.size(values) > 0, F.element_at(values, -1))

    return records.select(
        F.upper("model").alias("model"),
        F.coalesce("timestamp", F.lit("N/A")).alias("timestamp"),
        F.array_sort(F.map_entries("params")).alias("params"),
        last("train_loss").alias("final_train_loss"),
        last("val_loss").alias("final_val_loss"),
        F.coalesce(F.try_element_at("params", F.lit("best_epoch")), F.lit("N/A")).alias("best_epoch"),
    )


def constant_map(values: Mapping[str, object]) -> Column:
    """Literal MAP<STRING,STRING>, for model parameters in metric records."""
    entries = [F.lit(str(x)) for item in values.items() for x in item]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
