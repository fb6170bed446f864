"""Bar and dataset files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import nan_to_null
from tickloom.settings import materialize

OFI_BAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("ofi", T.DoubleType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("bar_start", T.LongType()),
        T.StructField("bar_end", T.LongType()),
    ]
)
# Fixed value: name pattern of bar files.
BAR_FILE_PATTERN = "ofi5m_*.parquet"
# A footer of a few columns is far smaller.
FOOTER_BYTES = 1 << 16
REQUIRED = ("date", "symbol", "bucket", "ofi")


def coerce_bars(bars: DataFrame) -> DataFrame:
    """Cast bar columns to their schema types, NaN to NULL; fail on a missing one."""
    missing = [c for c in REQUIRED if c not in bars.columns]
    if missing:
        raise ValueError(f"bar files lack columns: {', '.join(missing)}")
    casts = {f.name: F.col(f.name).cast(f.dataType) for f in OFI_BAR_SCHEMA if f.name in bars.columns}
    return bars.withColumns(casts).withColumn("ofi", nan_to_null(F.col("ofi")))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns and types of Parquet files by their last bytes; null for a file that isn't one."""
    for batch in batches:
        layouts = []
        for tail in batch.column(1).to_pylist():
            try:
                schema = pq.read_schema(pa.BufferReader(tail))
                layouts.append(json.dumps([(f.name, str(f.type)) for f in schema]))
            except (pa.ArrowInvalid, OSError):
                layouts.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(layouts, pa.string())], names=["path", "layout"])


def bar_file_layouts(spark: SparkSession, path: str, skip_combined: bool = True) -> DataFrame:
    """``path`` and ``layout`` (columns and types) of every bar file, by its footer; null if it has none.

    A bar file is small, one symbol's day; tasks read it whole and hand on its end.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", BAR_FILE_PATTERN).load(path)
    if skip_combined:
        files = files.filter(~F.regexp_extract("path", "([^/]+)$", 1).contains("combined"))
    tails = files.select("path", F.expr(f"substring(content, -{FOOTER_BYTES}, {FOOTER_BYTES})").alias("tail"))
    return tails.mapInArrow(_footers, "path string, layout string")


def read_bar_files(spark: SparkSession, path: str, skip_combined: bool = True) -> DataFrame:
    """All ``ofi5m_*.parquet`` files of a directory, whatever types their columns were written with.

    Files of one layout are one scan; its columns are cast to the schema of bars. A column that
    no file of a layout has is NULL there, unless it is required. A combined copy of the same bars
    may lie next to them; it is skipped unless asked for. Having no file at all is an error, as is
    a file that is not Parquet.
    """
    try:
        layouts = bar_file_layouts(spark, path, skip_combined).groupBy("layout").agg(F.collect_list("path").alias("paths"))
        found = layouts.collect()  # as many rows as layouts, and the names of the files
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if not found:
        raise FileNotFoundError(f"no bar files in {path}")
    broken = sorted(p for row in found if row.layout is None for p in row.paths)
    if broken:
        raise ValueError(f"not Parquet files: {', '.join(broken)}")
    parts = []
    for row in sorted(found, key=lambda r: r.layout):
        bars = coerce_bars(spark.read.parquet(*sorted(row.paths)))
        parts.append(bars.select(*(f.name for f in OFI_BAR_SCHEMA if f.name in bars.columns)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _write_file(bars: pa.Table, path: str) -> pa.Table:
    """One symbol's day as a file; written aside and moved, so a repeated task replaces it whole."""
    symbol, day = bars.column("symbol")[0].as_py(), bars.column("date")[0].as_py()
    store, folder = FileSystem.from_uri(path)
    name = f"{folder}/ofi5m_{symbol}_{day}.parquet"
    aside = f"{folder}/_{uuid.uuid4().hex}"
    pq.write_table(bars.sort_by("bucket"), aside, filesystem=store)
    store.move(aside, name)
    return pa.table({"symbol": [symbol], "date": [str(day)], "n_bars": [bars.num_rows]})


def write_bar_files(bars: DataFrame, path: str) -> DataFrame:
    """One file ``ofi5m_<symbol>_<date>.parquet`` per symbol and day; returns ``symbol``, ``date``, ``n_bars``.

    For readers that know these names; a symbol's day has few bars. Tasks write them, so ``path`` must be
    a folder they share. Prefer ``write_bar_partitions``, which makes larger files.
    """
    path = re.sub("^file:/+", "/", path)
    store, folder = FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    written = bars.filter("symbol IS NOT NULL AND date IS NOT NULL").groupBy("symbol", "date")
    listed = written.applyInArrow(lambda bars: _write_file(bars, path), "symbol string, date string, n_bars long")
    return materialize(listed.withColumn("date", F.col("date").cast("date")), "bar-files")


def write_bar_partitions(bars: DataFrame, path: str, partition_by: Sequence[str] = ("date",)) -> None:
    """Replace exactly the partitions present in ``bars``.

    The rebalance lets AQE merge small days into one task and split a huge one.
    By day as a rule: a directory per (symbol, day) means one tiny file per
    symbol-day, but ``("symbol", "date")`` gives just that where it is wanted.
    """
    (
        bars.hint("rebalance", *partition_by)
        .sortWithinPartitions(*partition_by, "symbol", "bucket")
        .write.partitionBy(*partition_by)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def read_bar_partitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OFI_BAR_SCHEMA).parquet(path)


def write_combined(df: DataFrame, path: str, order: Sequence[str] = ("symbol", "date", "bucket")) -> None:
    """One totally ordered copy. Keep it in a directory of its own."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def order_violations(spark: SparkSession, path: str, order: Sequence[str] = ("symbol", "date", "bucket")) -> DataFrame:
    """``n_rows`` and ``n_violations``: rows of a combined copy that come before the row in front of them.

    Rows are compared within a file by their place in it, and files by their last and first
    rows in the order of file names. Equal keys are in order; NULL comes first.
    """
    key = F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order))
    rows = spark.read.parquet(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"), key.alias("key")
    )
    before = F.lag("key").over(Window.partitionBy("file").orderBy("place"))
    files = rows.withColumn("before", before).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("key") < F.col("before")).alias("within"),
        F.min_by("key", "place").alias("first"),
        F.max_by("key", "place").alias("last"),
    )
    # One row per file.
    between = files.withColumn("ended", F.lag("last").over(Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long"), "file")))
    return between.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("within") + F.coalesce((F.col("first") < F.col("ended")).cast("long"), F.lit(0))), F.lit(0)).alias("n_violations"),
    )


def write_bucketed(bars: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """A table whose files hold whole symbols, in the order of time.

    Statistics and windows by symbol read it without an exchange. A symbol has at most one bar per
    bucket of a day, so no bucket of files is much larger than its symbols are many.
    """
    placed = bars.repartition(buckets, "symbol").sortWithinPartitions("symbol", "date", "bucket")
    writer = placed.write.bucketBy(buckets, "symbol").sortBy("date", "bucket").mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
