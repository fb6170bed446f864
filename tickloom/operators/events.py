"""Quotes to order-flow events and order-flow bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as fn
from tickloom.settings import NS_PER_SECOND, SLOT_SECONDS, BarSpec

DAY_KEYS = ["symbol", "date"]
BAR_KEYS = ["symbol", "date", "bucket"]
PIECE_KEYS = [*BAR_KEYS, "slot"]
TIME_ORDER = ["time_ns", "seq"]
QUOTE_FIELDS = ["best_bid", "best_bidsiz", "best_ask", "best_asksiz"]


def session_quotes(quotes: DataFrame, spec: BarSpec = BarSpec()) -> DataFrame:
    """Quotes inside the session, with their bar.

    Filtered before any LAG: the first quote of a session has no predecessor,
    even if an earlier quote exists, and Catalyst may not move it for us.
    """
    keyed = F.col("symbol").isNotNull() & F.col("date").isNotNull()
    return quotes.filter(fn.in_session(F.col("time_ns"), spec.session) & keyed).withColumn(
        "bucket", fn.time_bucket(F.col("time_ns"), spec.bar_seconds)
    )


def _terms(current: str, previous: str) -> tuple[Column, Column]:
    """Bid and ask event terms between two quote structs."""
    now = {f: F.col(f"{current}.{f}") for f in QUOTE_FIELDS}
    was = {f: F.col(f"{previous}.{f}") for f in QUOTE_FIELDS}
    return (
        fn.bid_event(now["best_bid"], now["best_bidsiz"], was["best_bid"], was["best_bidsiz"]),
        fn.ask_event(now["best_ask"], now["best_asksiz"], was["best_ask"], was["best_asksiz"]),
    )


def _has_previous(previous: str) -> Column:
    return F.col(f"{previous}.best_bid").isNotNull() & F.col(f"{previous}.best_ask").isNotNull()


def _pieces(quotes: DataFrame, spec: BarSpec, slot_seconds: float) -> DataFrame:
    """Quotes of the session with the fixed time slot that cuts their bar.

    A session's quotes have a time, so neither key is ever missing; saying so keeps joins on them
    from adding filters to one of two equal exchanges.
    """
    slot = F.floor(F.col("time_ns") / F.lit(int(slot_seconds * NS_PER_SECOND))).cast("long")
    keys = [F.coalesce(F.col("bucket"), F.lit(0)).alias("bucket"), F.coalesce(slot, F.lit(0)).alias("slot")]
    return session_quotes(quotes, spec).select(*DAY_KEYS, *keys, *TIME_ORDER, F.struct(*QUOTE_FIELDS).alias("quote"))


def ofi_events(quotes: DataFrame, spec: BarSpec = BarSpec(), slot_seconds: float = SLOT_SECONDS) -> DataFrame:
    """One row per quote that has a predecessor in the session, with its two terms.

    LAG runs inside a piece, a fixed slot of seconds of a bar, so a busy symbol-day or bar is
    spread over many tasks. The first quote of each piece takes its predecessor
    from the last quote of the piece before, found among one row per piece. Both read the same
    exchange, so the quotes are scanned and moved once.
    """
    rows = _pieces(quotes, spec, slot_seconds).repartition(*PIECE_KEYS)
    last = rows.groupBy(*PIECE_KEYS).agg(F.max_by("quote", F.struct(*TIME_ORDER)).alias("last_quote"))
    day = Window.partitionBy(*DAY_KEYS).orderBy("bucket", "slot")
    carried = last.select(*PIECE_KEYS, F.lag("last_quote").over(day).alias("carried"))
    within = F.lag("quote").over(Window.partitionBy(*PIECE_KEYS).orderBy(*TIME_ORDER))
    linked = rows.withColumn("within", within).join(carried, PIECE_KEYS).withColumn("previous", F.coalesce("within", "carried"))
    e_bid, e_ask = _terms("quote", "previous")
    return linked.filter(_has_previous("previous")).select(
        *BAR_KEYS,
        *TIME_ORDER,
        "quote.*",
        *(F.col(f"previous.{f}").alias(f"prev_{f.removeprefix('best_')}") for f in QUOTE_FIELDS),
        e_bid.alias("e_bid"),
        e_ask.alias("e_ask"),
    )


def ofi_bars(quotes: DataFrame, spec: BarSpec = BarSpec(), slot_seconds: float = SLOT_SECONDS) -> DataFrame:
    """Order-flow imbalance per (symbol, date, bar).

    Quotes move once, hashed on (symbol, date, bar, slot), and are ordered and
    summed there. What is left of each piece (its sum, its first and last quote)
    is all that the second, per-day window sees: it adds the event between the
    last quote of a piece and the first of the next.
    """
    rows = _pieces(quotes, spec, slot_seconds)
    order = Window.partitionBy(*PIECE_KEYS).orderBy(*TIME_ORDER)
    linked = rows.withColumn("within", F.lag("quote").over(order))
    e_bid, e_ask = _terms("quote", "within")
    counted = _has_previous("within")
    summed = linked.groupBy(*PIECE_KEYS).agg(
        F.sum(F.when(counted, e_bid + e_ask)).alias("inner_ofi"),
        F.count(F.when(counted, F.lit(1))).alias("inner_events"),
        F.min(F.when(counted, F.col("time_ns"))).alias("inner_start"),
        F.max(F.when(counted, F.col("time_ns"))).alias("inner_end"),
        F.min(F.struct(*TIME_ORDER, "quote")).alias("first"),
        F.max(F.struct(*TIME_ORDER, "quote")).alias("last"),
    )
    day = Window.partitionBy(*DAY_KEYS).orderBy("bucket", "slot")
    joined = summed.select(
        "*",
        F.col("first.quote").alias("first_quote"),
        F.lag("last.quote").over(day).alias("carried"),
    )
    edge_bid, edge_ask = _terms("first_quote", "carried")
    edge = _has_previous("carried")
    edges = joined.withColumns(
        {
            "edge_ofi": F.when(edge, edge_bid + edge_ask),
            "edge_events": edge.cast("long"),
            "edge_time": F.when(edge, F.col("first.time_ns")),
        }
    )
    inner, outer = F.sum("inner_ofi"), F.sum("edge_ofi")
    return (
        edges.groupBy(*BAR_KEYS)
        .agg(
            F.when(inner.isNotNull() | outer.isNotNull(), F.coalesce(inner, F.lit(0.0)) + F.coalesce(outer, F.lit(0.0))).alias("ofi"),
            F.sum(F.col("inner_events") + F.col("edge_events")).alias("n_events"),
            F.min(F.least("inner_start", "edge_time")).alias("bar_start"),
            F.max(F.greatest("inner_end", "edge_time")).alias("bar_end"),
        )
        .filter(F.col("n_events") > 0)
    )
