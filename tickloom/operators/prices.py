"""Quotes to mid-price bars, and bars to returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as fn
from tickloom.operators.events import BAR_KEYS, DAY_KEYS, TIME_ORDER, session_quotes
from tickloom.operators.ordered import row_positions
from tickloom.settings import MAX_SLICE_ROWS, BarSpec


def priced_quotes(quotes: DataFrame, spec: BarSpec = BarSpec()) -> DataFrame:
    """In-session quotes with two positive prices, their mid and their spread."""
    bid, ask = F.col("best_bid"), F.col("best_ask")
    return (
        session_quotes(quotes, spec)
        .filter(fn.positive_quote(bid, ask))
        .select(*BAR_KEYS, *TIME_ORDER, fn.mid_quote(bid, ask).alias("mid"), fn.spread(bid, ask).alias("spread"))
    )


def price_bars(quotes: DataFrame, spec: BarSpec = BarSpec()) -> DataFrame:
    """Open, close, plain mean mid (named ``bar_vwap``), mean spread and count.

    First and last come from hashed ordered aggregates, which combine map-side: nothing is
    sorted, and a hot bar reaches its reducer as one row per map task.
    """
    order = fn.order_key(*map(F.col, TIME_ORDER))
    return (
        priced_quotes(quotes, spec)
        .groupBy(*BAR_KEYS)
        .agg(
            F.min_by("mid", order).alias("bar_open"),
            F.max_by("mid", order).alias("bar_close"),
            F.avg("mid").alias("bar_vwap"),
            F.avg("spread").alias("avg_spread"),
            F.count(F.lit(1)).alias("n_quotes"),
        )
    )


def price_bars_ranked(quotes: DataFrame, spec: BarSpec = BarSpec(), max_rows: int = MAX_SLICE_ROWS) -> DataFrame:
    """Same bars by row numbers from both ends and a conditional-max pivot."""
    ranked = row_positions(priced_quotes(quotes, spec), BAR_KEYS, TIME_ORDER, max_rows)
    return ranked.groupBy(*BAR_KEYS).agg(
        F.max(F.when(F.col("from_start") == 1, F.col("mid"))).alias("bar_open"),
        F.max(F.when(F.col("from_end") == 1, F.col("mid"))).alias("bar_close"),
        F.avg("mid").alias("bar_vwap"),
        F.avg("spread").alias("avg_spread"),
        F.count(F.lit(1)).alias("n_quotes"),
    )


def price_bars_full(quotes: DataFrame, spec: BarSpec = BarSpec()) -> DataFrame:
    """Bars with low and high; means are over distinct (mid, time) pairs.

    The first grouping is finer than a bar, so it also spreads a hot bar; the
    second combines map-side and gives what first/last/min/max/avg windows over
    the bar followed by DISTINCT would give, one row per bar.
    """
    moments = (
        priced_quotes(quotes, spec)
        .groupBy(*BAR_KEYS, "mid", "time_ns")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.avg("spread").alias("spread"),
            F.min("seq").alias("seq_low"),
            F.max("seq").alias("seq_high"),
        )
    )
    return moments.groupBy(*BAR_KEYS).agg(
        F.min_by("mid", fn.order_key(F.col("time_ns"), F.col("seq_low"))).alias("bar_open"),
        F.max_by("mid", fn.order_key(F.col("time_ns"), F.col("seq_high"))).alias("bar_close"),
        F.avg("mid").alias("bar_vwap"),
        F.min("mid").alias("bar_low"),
        F.max("mid").alias("bar_high"),
        F.sum("copies").alias("n_quotes"),
        F.avg("spread").alias("avg_spread"),
    )


def bar_returns(bars: DataFrame) -> DataFrame:
    """Simple and log return of the close within a day; one-bar days are dropped.

    The per-day window is bounded by the number of bars in a day.
    """
    day = Window.partitionBy(*DAY_KEYS)
    before = F.lag("bar_close").over(day.orderBy("bucket"))
    ratio = F.try_divide(F.col("bar_close"), F.col("before"))
    return (
        bars.withColumns({"before": before, "bars_in_day": F.count(F.lit(1)).over(day)})
        .filter(F.col("bars_in_day") >= 2)
        .withColumns({"bar_return": ratio - 1, "log_return": F.ln(ratio)})
        .drop("before", "bars_in_day")
    )


def return_stats(returns: DataFrame) -> DataFrame:
    """Number, mean and deviation of bar returns per symbol, in basis points."""
    return returns.groupBy("symbol").agg(
        F.count("bar_return").alias("n"),
        fn.basis_points(F.avg("bar_return")).alias("mean_bps"),
        fn.basis_points(F.stddev_samp("bar_return")).alias("std_bps"),
    )
