"""Discovery of daily quote tables in a catalog schema or a directory tree."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import try_parse_date
from tickloom.operators.calendar import dates_from_names, weekdays
from tickloom.sources.quotes import QUOTE_SCHEMA, prices_not_nan, select_quotes


def list_catalog_tables(spark: SparkSession, schema: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {schema} LIKE 'nbbom_*'").select(F.col("tableName").alias("table_name"))


def list_table_folders(spark: SparkSession, root: str) -> DataFrame:
    """Names of daily folders ``nbbom_YYYYMMDD``; only paths are listed, nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_extract("path", r"/(nbbom_[^/]+)/[^/]+$", 1)
    return files.select(name.alias("table_name")).filter(F.col("table_name") != "").distinct()


def discover_days(spark: SparkSession, schema: str, start: date, end: date) -> DataFrame:
    """Days with a daily table between two dates; all weekdays if the schema is unreadable."""
    try:
        tables = list_catalog_tables(spark, schema)
    except AnalysisException:
        return weekdays(spark, start, end)
    return dates_from_names(tables).filter(F.col("date").between(F.lit(start), F.lit(end))).select("date")


def read_daily_folders(
    spark: SparkSession,
    root: str,
    symbols: Iterable[str] | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Quotes of all daily folders in one scan, the date taken from the folder name.

    A date range is a condition on file paths, so other days' files are not opened.
    """
    stored = T.StructType(QUOTE_SCHEMA.fields[:-1])
    rows = spark.read.schema(stored).option("recursiveFileLookup", True).parquet(root)
    day = try_parse_date(F.regexp_extract("_metadata.file_path", r"/nbbom_([^/]+)/[^/]+$", 1))
    dated = rows.withColumn("date", day).filter(F.col("date").isNotNull())
    return prices_not_nan(select_quotes(dated, symbols, start, end))


# How a table's description spells its columns and storage.
_COLUMN = r"\|-- ([^:]+): (.+) \(nullable"
FILE_FORMATS = ("parquet", "orc")


def describe_daily_tables(spark: SparkSession, schema: str) -> DataFrame:
    """``table_name``, ``location``, ``format`` and ``columns`` (name to type) of a schema's daily tables.

    One catalog call for all of them. Views and tables partitioned further have no ``location``.
    """
    shown = spark.sql(f"SHOW TABLE EXTENDED IN {schema} LIKE 'nbbom_*'")
    text = F.col("information")
    whole = ~text.rlike(r"(?m)^Partition Columns: \[[^\]]") & ~text.rlike(r"(?m)^Type: VIEW")
    place = F.nullif(F.regexp_extract(text, r"(?m)^Location: (.+)$", 1), F.lit(""))
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_COLUMN), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(_COLUMN), F.lit(2)).alias("type")
    )
    return shown.select(
        F.col("tableName").alias("table_name"),
        F.when(whole, place).alias("location"),
        F.lower(F.regexp_extract(text, r"(?m)^Provider: (.+)$", 1)).alias("format"),
        F.map_from_entries(pairs).alias("columns"),
    )


def _folder(path: Column) -> Column:
    """A folder's path without the slashes in which spellings of one path differ."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "/+$", "")


def read_daily_tables(
    spark: SparkSession, schema: str, start: date, end: date, symbols: Iterable[str] | None = None
) -> DataFrame:
    """Quotes of a schema's daily tables between two dates; absent days are skipped.

    Tables of files with equal columns are one scan over all their folders, so the plan doesn't
    grow with the days; a folder's day is joined from the list of tables. Other tables (views,
    other providers, further partitions) are read one by one.
    """
    described = describe_daily_tables(spark, schema)
    found = dates_from_names(described).filter(F.col("date").between(F.lit(start), F.lit(end)))
    wanted = found.join(described, "table_name").orderBy("date").collect()  # one row per day
    if not wanted:
        raise FileNotFoundError(f"no daily tables in {schema} from {start} to {end}")
    fields = QUOTE_SCHEMA.fields[:-1]
    groups: dict[tuple, list] = {}
    for row in wanted:
        kinds = tuple(row["columns"].get(f.name) for f in fields)
        one_scan = row.location is not None and row.format in FILE_FORMATS and None not in kinds
        groups.setdefault((row.format, kinds) if one_scan else (row.table_name,), []).append(row)
    parts = []
    for (kind, *types), rows in groups.items():
        if types:
            stored = ", ".join(f"{f.name} {t}" for f, t in zip(fields, types[0]))
            scan = spark.read.schema(stored).format(kind).load([r.location for r in rows])
            days = spark.createDataFrame([(r.location, r.date) for r in rows], "_location string, date date")
            days = days.select(_folder(F.col("_location")).alias("_folder"), "date")
            scan = scan.withColumn("_folder", _folder(F.regexp_replace("_metadata.file_path", "/[^/]+$", "")))
            quotes = scan.join(days, "_folder")
        else:
            quotes = spark.table(f"{schema}.`{kind}`").withColumn("date", F.lit(rows[0].date))
        parts.append(quotes.select(*(F.col(f.name).cast(f.dataType) for f in fields), "date"))
    return prices_not_nan(select_quotes(reduce(DataFrame.unionByName, parts), symbols))
