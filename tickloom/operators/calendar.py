"""Trading calendar, daily-table discovery and extraction completeness."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalar as fn

# United States market holidays of 2023.
US_HOLIDAYS_2023 = (
    date(2023, 1, 2),
    date(2023, 1, 16),
    date(2023, 2, 20),
    date(2023, 4, 7),
    date(2023, 5, 29),
    date(2023, 6, 19),
    date(2023, 7, 4),
    date(2023, 9, 4),
    date(2023, 11, 23),
    date(2023, 12, 25),
)

# Fixed value: name of a daily table, its date behind the prefix.
TABLE_NAME_PATTERN = r"^nbbom_(.*)$"


def _weekday_array(start: Column, end: Column) -> Column:
    return F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)


def weekdays(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Monday to Friday of an inclusive range."""
    return spark.range(1).select(F.explode(_weekday_array(F.lit(start), F.lit(end))).alias("date"))


def weekdays_of_year(spark: SparkSession, year: int) -> DataFrame:
    return weekdays(spark, date(year, 1, 1), date(year, 12, 31))


def reconcile_calendar(calendar: DataFrame, available: DataFrame, holidays: Iterable[date]) -> DataFrame:
    """Status of each calendar day: present, holiday or missing."""
    present = available.select("date").distinct().withColumn("_present", F.lit(True))
    status = (
        F.when(F.col("_present"), "present")
        .when(F.col("date").isin(list(holidays)), "holiday")
        .otherwise("missing")
    )
    return calendar.join(present, "date", "left").select("date", status.alias("status"))


def stored_days(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    """Days of a tree partitioned by day, from its paths alone: files are listed, none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    day = F.regexp_extract("path", f"/{column}=([^/]+)/", 1)
    return files.select(fn.try_parse_date(day).alias("date")).filter(F.col("date").isNotNull()).distinct()


def dates_from_names(tables: DataFrame, column: str = "table_name") -> DataFrame:
    """Distinct dates of daily tables; names without a valid date are skipped.

    Of several tables of one day, the one whose name packs the date in eight digits counts.
    """
    text = F.regexp_extract(column, TABLE_NAME_PATTERN, 1)
    return (
        tables.select(F.col(column).alias("table_name"), fn.try_parse_date(text).alias("date"))
        .filter(F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.min(F.struct(~F.col("table_name").rlike("^nbbom_[0-9]{8}$"), "table_name"))["table_name"].alias("table_name"))
    )


def existing_days(requested: DataFrame, discovered: DataFrame) -> DataFrame:
    """Requested days that have a daily table; the others are skipped."""
    return requested.join(discovered.select("date"), "date", "left_semi")


def completeness(bars: DataFrame, days: DataFrame, symbols: Iterable[str]) -> DataFrame:
    """Expected against extracted (symbol, day) tasks.

    Expected is every listed symbol on every given day, whatever the weekday; each day unfolds
    the list. A missing task shows as ``skipped``.
    """
    names = F.array(*(F.lit(s) for s in dict.fromkeys(symbols))).cast("array<string>")
    tasks = days.select("date").distinct().select(F.explode(names).alias("symbol"), "date")
    done = bars.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n_bars"))
    return tasks.join(done, ["symbol", "date"], "left").select(
        "symbol",
        "date",
        F.coalesce("n_bars", F.lit(0)).alias("n_bars"),
        F.when(F.col("n_bars").isNotNull(), "extracted").otherwise("skipped").alias("status"),
    )
