"""Quote sources: date-partitioned Parquet, daily tables, JDBC, and a view of an event stream."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import scalar as fn
from tickloom.settings import NS_PER_SECOND

QUOTE_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("time_ns", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("best_bid", T.DoubleType()),
        T.StructField("best_bidsiz", T.DoubleType()),
        T.StructField("best_ask", T.DoubleType()),
        T.StructField("best_asksiz", T.DoubleType()),
        T.StructField("date", T.DateType()),
    ]
)


def select_quotes(
    quotes: DataFrame,
    symbols: Iterable[str] | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Restrict to symbols and an inclusive date range; dates prune partitions."""
    if start is not None:
        quotes = quotes.filter(F.col("date") >= F.lit(start))
    if end is not None:
        quotes = quotes.filter(F.col("date") <= F.lit(end))
    if symbols is not None:
        # Plain equality, so that it reaches the Parquet scan.
        quotes = quotes.filter(F.col("symbol").isin(fn.clean_symbols(symbols)))
    return quotes


def prices_not_nan(quotes: DataFrame) -> DataFrame:
    doubles = ["best_bid", "best_bidsiz", "best_ask", "best_asksiz"]
    return quotes.withColumns({c: fn.nan_to_null(F.col(c)) for c in doubles})


def read_quotes(
    spark: SparkSession,
    path: str,
    symbols: Iterable[str] | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """All symbols of a ``date=``-partitioned Parquet tree in one scan."""
    quotes = spark.read.schema(QUOTE_SCHEMA).parquet(path)
    return prices_not_nan(select_quotes(quotes, symbols, start, end))


def jdbc_day_predicates(days: Iterable[date], column: str = "date") -> list[str]:
    """One WHERE clause, hence one Spark partition, per day."""
    return [f"{column} = DATE '{d:%Y-%m-%d}'" for d in sorted(set(days))]


def read_quotes_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    days: Iterable[date],
    symbols: Iterable[str] | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Quotes from a database table with the columns of ``QUOTE_SCHEMA``.

    Credentials belong in ``properties``, filled by the caller from job options.
    """
    rows = spark.read.jdbc(url, table, predicates=jdbc_day_predicates(days), properties=dict(properties or {}))
    cast = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in QUOTE_SCHEMA))
    return prices_not_nan(select_quotes(cast, symbols))


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def time_of_day_ns(ts: Column) -> Column:
    """Nanoseconds since midnight of a timestamp without time zone."""
    since_midnight = ts - ts.cast("date").cast("timestamp_ntz")
    seconds = since_midnight.cast("interval second").cast("decimal(18,6)")
    return (seconds * NS_PER_SECOND).cast("long")


def quotes_from_events(events: DataFrame) -> DataFrame:
    """Deterministic quotes out of an (event_id, ts, user_id, event_type, value, props) table.

    Prices are whole ticks so that equal prices occur; ``k`` in ``props`` decides
    on zero bids, missing asks and the spread.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    tick = F.floor(F.col("value") / 20).cast("int")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("date").alias("date"),
        time_of_day_ns(F.col("ts")).alias("time_ns"),
        F.col("event_id").alias("seq"),
        F.when(k == 0, F.lit(0.0)).otherwise((tick + 10000) / F.lit(100.0)).alias("best_bid"),
        (F.col("user_id") % 10 + 1).cast("double").alias("best_bidsiz"),
        F.when(k != 99, (tick + 10001 + k % 3) / F.lit(100.0)).alias("best_ask"),
        (F.col("event_id") % 7 + 1).cast("double").alias("best_asksiz"),
    )


def read_event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_from_events(spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet"))
