import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.sources.quotes import QUOTE_SCHEMA  # noqa: E402

DAY = dt.date(2023, 1, 3)
OPEN_NS = (9 * 3600 + 30 * 60) * 1_000_000_000


def rows_of(df):
    """Rows in a canonical order, to compare whole results."""
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_quotes(spark):
    """Quotes from (time_ns, seq, bid, bidsiz, ask, asksiz) rows of one symbol and day."""

    def build(rows, symbol="AAA", day=DAY):
        return spark.createDataFrame([(symbol, *r, day) for r in rows], QUOTE_SCHEMA)

    return build


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from (symbol, day, bucket, ofi) rows."""

    def build(rows):
        return spark.createDataFrame(rows, "symbol string, date date, bucket int, ofi double")

    return build
