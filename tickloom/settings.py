"""Parameters shared by the operators, and the shared folder for materialised data."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

NS_PER_SECOND = 1_000_000_000

# Bar width, lag sets and feature names of the modelling dataset.
BAR_SECONDS = 300
BAR_LAGS = (1, 2, 3, 6, 12)
PAIR_LAGS = (1, 2, 3, 6)
ACF_LAGS = (1, 2, 3, 6, 12, 24)
SEQUENCE_LENGTH = 24
FEATURES = ("ofi_z", "lag1", "lag2", "lag3", "lag6", "lag12")
TARGET = "y_next"

# Width of the pieces in which quotes are put in order; a piece is never wider than a bar.
SLOT_SECONDS = 5
# Rows one task may have to number by itself before its group is split further.
MAX_SLICE_ROWS = 5_000_000
CHUNK_ROWS = 100_000

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders of the tables written so far within ``materialize_last``.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@dataclass(frozen=True)
class SessionHours:
    """Half-open trading session, in seconds since midnight."""

    open_s: int = 9 * 3600 + 30 * 60
    close_s: int = 16 * 3600


@dataclass(frozen=True)
class SplitDates:
    """Inclusive date bounds of the train / val / test labels."""

    train_end: date
    val_start: date
    val_end: date
    test_start: date


@dataclass(frozen=True)
class BarSpec:
    """Bar width and trading session; the two always travel together."""

    bar_seconds: int = BAR_SECONDS
    session: SessionHours = field(default_factory=SessionHours)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder. A cluster
    session without it is refused: an executor's own disk dies with it.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="tickloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path inside the shared folder, different on every call.

    All paths of one application lie in one subfolder, to be removed with it.
    """
    root = shared_dir(spark).rstrip("/")
    return f"{root}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    A written table keeps columnar pruning for later steps, which a
    row-based ``checkpoint()`` does not. The shuffle files of the write go
    with it, instead of when the driver's memory is next cleaned up.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (written := _written.get()) is not None:
        written.append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize_last(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize(make())``, without the tables that were materialised for it.

    Only for a ``make`` whose tables nothing else reads. Folders go by way of Spark's own file
    systems, so that any shared folder will do.
    """
    outer, written = _written.get(), []
    token = _written.set(written)
    try:
        made = materialize(make(), name)
    finally:
        _written.reset(token)
    *used, last = written
    for path in used:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if outer is not None:
        outer.append(last)
    return made
