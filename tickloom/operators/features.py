"""Bars to a modelling dataset: normalisation, lags, targets, splits, sequences."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import scalar as fn
from tickloom.operators.events import BAR_KEYS, DAY_KEYS
from tickloom.operators.ordered import history_positions, over_chunks, shift_columns
from tickloom.settings import (
    BAR_LAGS,
    BAR_SECONDS,
    CHUNK_ROWS,
    FEATURES,
    SEQUENCE_LENGTH,
    TARGET,
    SplitDates,
)


def dedup_bars(bars: DataFrame) -> DataFrame:
    """One row per (symbol, date, bucket); combines map-side, so hot copies shrink early."""
    return bars.dropDuplicates(BAR_KEYS)


def add_bar_time(bars: DataFrame, bar_seconds: int = BAR_SECONDS) -> DataFrame:
    day, bucket = F.col("date"), F.col("bucket")
    return bars.withColumns(
        {"datetime": fn.bar_datetime(day, bucket, bar_seconds), "bar_time": fn.bar_clock(day, bucket, bar_seconds)}
    )


def zscore_daily(bars: DataFrame, value: str = "ofi", name: str = "ofi_z") -> DataFrame:
    """Standardise within (symbol, day) by sample deviation. Looks ahead within the day."""
    day = Window.partitionBy(*DAY_KEYS)
    return bars.withColumn(name, fn.standardize(F.col(value), F.avg(value).over(day), F.stddev_samp(value).over(day)))


def zscore_expanding(bars: DataFrame, value: str = "ofi", name: str = "ofi_z") -> DataFrame:
    """Standardise by the day's bars so far, population deviation; the first bar is 0."""
    so_far = Window.partitionBy(*DAY_KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    z = fn.standardize(F.col(value), F.avg(value).over(so_far), F.stddev_pop(value).over(so_far))
    first = F.row_number().over(Window.partitionBy(*DAY_KEYS).orderBy("bucket")) == 1
    return bars.withColumn(name, F.when(first, F.lit(0.0)).otherwise(z))


def training_stats(bars: DataFrame, train_end: date, value: str = "ofi") -> DataFrame:
    """Mean and sample deviation per symbol over dates up to ``train_end``."""
    seen = F.when(F.col("date") <= F.lit(train_end), F.col(value))
    return bars.groupBy("symbol").agg(F.avg(seen).alias("train_mean"), F.stddev_samp(seen).alias("train_std"))


def zscore_training(bars: DataFrame, train_end: date, value: str = "ofi", name: str = "ofi_z") -> DataFrame:
    """Standardise every row by its symbol's training period.

    No broadcast hint: AQE measures the statistics and broadcasts them when
    small, otherwise it sort-merges and splits a skewed symbol.
    """
    stats = training_stats(bars, train_end, value)
    z = fn.standardize(F.col(value), F.col("train_mean"), F.col("train_std"))
    return bars.join(stats, "symbol", "left").withColumn(name, z).drop("train_mean", "train_std")


def add_lags(
    bars: DataFrame,
    lags: Iterable[int] = BAR_LAGS,
    value: str = "ofi_z",
    reset_daily: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``lag{k}`` columns and the next-bar target.

    Positional over a symbol's history, across midnight and over missing bars;
    ``reset_daily`` keeps them inside a day.
    """
    lags = list(lags)
    if reset_daily:
        day = Window.partitionBy(*DAY_KEYS).orderBy("bucket")
        columns = {f"lag{k}": F.lag(value, k).over(day) for k in lags}
        return bars.withColumns({**columns, TARGET: F.lead(value, 1).over(day)})
    shifts = {f"lag{k}": (value, k) for k in lags}
    return shift_columns(bars, ["symbol"], {**shifts, TARGET: (value, -1)}, chunk_rows)


def add_lags_in_place(bars: DataFrame, lags: Iterable[int] = BAR_LAGS, value: str = "ofi_z") -> DataFrame:
    """``add_lags`` of unique bars that already lie together by symbol: a plain window, no exchange.

    A symbol has at most one bar per bucket of a day, so its history is bounded by time.
    """
    history = Window.partitionBy("symbol").orderBy("date", "bucket")
    columns = {f"lag{k}": F.lag(value, k).over(history) for k in lags}
    return bars.withColumns({**columns, TARGET: F.lead(value, 1).over(history)})


def add_split(df: DataFrame, dates: SplitDates) -> DataFrame:
    return df.withColumn("split", fn.split_label(F.col("date"), dates))


def split_frames(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows."""
    return tuple(df.filter(F.col("split") == name) for name in ("train", "val", "test"))


def present_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Wanted columns the frame really has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def complete_cases(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    return df.dropna(how="any", subset=[*features, target])


def add_ofi_changes(
    dataset: DataFrame, lags: Iterable[int] = BAR_LAGS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Next-bar OFI, z and sign; first differences; lags of the z difference.

    A lagged difference is a difference of two lags, so one pass is enough.
    """
    lags = list(lags)
    needed = sorted({1, *lags, *(k + 1 for k in lags)})
    shifts = {
        "next_ofi": ("ofi", -1),
        "next_ofi_z": ("ofi_z", -1),
        "_ofi1": ("ofi", 1),
        **{f"_z{k}": ("ofi_z", k) for k in needed},
    }
    shifted = shift_columns(dataset, ["symbol"], shifts, chunk_rows)
    changes: dict[str, Column] = {
        "next_ofi_sign": F.signum("next_ofi_z"),
        "ofi_change": F.col("ofi") - F.col("_ofi1"),
        "ofi_z_change": F.col("ofi_z") - F.col("_z1"),
        **{f"ofi_change_lag{k}": F.col(f"_z{k}") - F.col(f"_z{k + 1}") for k in lags},
    }
    return shifted.withColumns(changes).drop("_ofi1", *(f"_z{k}" for k in needed))


def sliding_sequences(
    dataset: DataFrame,
    length: int = SEQUENCE_LENGTH,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    target_offset: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Blocks of ``length`` complete rows per (symbol, split) with a later target.

    The default target is that of the row after the block; groups of ``length``
    rows or fewer give none. Output grows ``length``-fold: store only if needed.
    """
    offset = length if target_offset is None else target_offset
    keys = ["symbol", "split"]
    rows = complete_cases(dataset, features, target).select(
        *BAR_KEYS, "split", F.array(*(F.col(c).cast("double") for c in features)).alias("_step"), F.col(target).alias("_y")
    )

    def build(window: WindowSpec) -> dict[str, Column]:
        return {
            "x": F.collect_list("_step").over(window.rowsBetween(0, length - 1)),
            "y": F.lead("_y", offset).over(window),
            "_follows": F.lead("pos", length).over(window),
        }

    positioned = history_positions(rows, keys)
    blocks = over_chunks(positioned, keys, 0, max(length, offset), build, chunk_rows)
    return blocks.filter(F.col("_follows").isNotNull()).select(
        *keys, (F.col("pos") + 1).alias("row_no"), "x", "y"
    )
