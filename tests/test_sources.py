import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DAY, OPEN_NS, rows_of
from tickloom import settings
from tickloom.operators import calendar
from tickloom.operators.features import dedup_bars
from tickloom.sources import bars as bar_files
from tickloom.sources import quotes as quote_files
from tickloom.sources import tables


def bar_frame(symbol, day, n=3):
    return pd.DataFrame({"date": [day] * n, "symbol": symbol, "bucket": range(n), "ofi": [1, 2, 3][:n], "n_events": 1})


def test_bar_files_and_combined_copy(spark, tmp_path):
    parts = [bar_frame(s, d) for s in ("AAA", "BBB") for d in ("2023-01-03", "2023-01-04")]
    for i, part in enumerate(parts):
        part.to_parquet(tmp_path / f"ofi5m_{i}.parquet", index=False)
    pd.concat(parts).to_parquet(tmp_path / "ofi5m_combined.parquet", index=False)
    bar_frame("CCC", "2023-01-03").to_parquet(tmp_path / "other.parquet", index=False)
    clean = bar_files.read_bar_files(spark, str(tmp_path))
    assert clean.count() == 12 and dict(clean.dtypes)["date"] == "date" and dict(clean.dtypes)["ofi"] == "double"
    doubled = bar_files.read_bar_files(spark, str(tmp_path), skip_combined=False)
    assert doubled.count() == 24 and rows_of(dedup_bars(doubled)) == rows_of(clean)


def test_missing_bar_files_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no bar files"):
        bar_files.read_bar_files(spark, str(tmp_path))
    bar_frame("AAA", "2023-01-03").to_parquet(tmp_path / "ofi5m_combined.parquet", index=False)
    with pytest.raises(FileNotFoundError, match="no bar files"):
        bar_files.read_bar_files(spark, str(tmp_path))
    with pytest.raises(ValueError, match="bucket, ofi"):
        bar_files.coerce_bars(spark.createDataFrame([("A", DAY)], "symbol string, date date"))


@pytest.mark.parametrize("layout", [("date",), ("symbol", "date")])
def test_daily_sink_replaces_only_its_partitions(spark, make_bars, tmp_path, layout):
    later = DAY + dt.timedelta(days=1)
    extra = {"n_events": F.lit(1).cast("long"), "bar_start": F.lit(0).cast("long"), "bar_end": F.lit(1).cast("long")}
    path = str(tmp_path / "bars")
    bar_files.write_bar_partitions(make_bars([("A", DAY, 1, 1.0), ("A", later, 1, 2.0)]).withColumns(extra), path, layout)
    bar_files.write_bar_partitions(make_bars([("A", later, 1, 9.0)]).withColumns(extra), path, layout)
    got = {r.date: r.ofi for r in bar_files.read_bar_partitions(spark, path).collect()}
    assert got == {DAY: 1.0, later: 9.0}


def test_combined_sink_is_sorted(spark, make_bars, tmp_path):
    rows = [(s, DAY, b, 1.0) for s in "CAB" for b in (3, 1, 2)]
    bar_files.write_combined(make_bars(rows), str(tmp_path / "c"))
    got = [(r.symbol, r.bucket) for r in bar_files.read_dataset(spark, str(tmp_path / "c")).collect()]
    assert sorted(got) == [(s, b) for s in "ABC" for b in (1, 2, 3)]


def stored_quotes(make_quotes, nan=float("nan")):
    return make_quotes([(OPEN_NS, 1, nan, 1.0, 10.0, 1.0), (OPEN_NS + 1, 2, 9.0, 1.0, 10.0, 1.0)]).unionByName(
        make_quotes([(OPEN_NS, 3, 9.0, 1.0, 10.0, 1.0)], "BBB", DAY + dt.timedelta(days=1))
    )


def test_quote_scan_prunes_days_and_pushes_symbols(spark, make_quotes, tmp_path):
    path = str(tmp_path / "quotes")
    stored_quotes(make_quotes).write.partitionBy("date").parquet(path)
    one = quote_files.read_quotes(spark, path, [" aaa "], DAY, DAY)
    assert [r.best_bid for r in one.orderBy("seq").collect()] == [None, 9.0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(symbol,AAA)" in plan
    assert quote_files.read_quotes(spark, path).count() == 3


def test_daily_folders(spark, make_quotes, tmp_path):
    later = DAY + dt.timedelta(days=1)
    for day in (DAY, later):
        part = stored_quotes(make_quotes).filter(F.col("date") == F.lit(day)).drop("date")
        part.write.parquet(str(tmp_path / f"nbbom_{day:%Y%m%d}"))
    names = tables.list_table_folders(spark, str(tmp_path))
    assert sorted(r.date for r in calendar.dates_from_names(names).collect()) == [DAY, later]
    got = tables.read_daily_folders(spark, str(tmp_path), ["AAA", "BBB"])
    assert sorted((r.symbol, r.date) for r in got.collect()) == [("AAA", DAY), ("AAA", DAY), ("BBB", later)]
    broken = tmp_path / "nbbom_20230109"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"never opened")
    ranged = tables.read_daily_folders(spark, str(tmp_path), start=later, end=later)
    assert [(r.symbol, r.date) for r in ranged.collect()] == [("BBB", later)]


def test_catalog_discovery_and_fallback(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS quotes_test")
    for name in ("nbbom_20230104", "nbbom_20230103", "nbbom_notes", "other_20230105"):
        spark.sql(f"DROP TABLE IF EXISTS quotes_test.{name}")
        spark.sql(f"CREATE TABLE quotes_test.{name} (x INT) USING parquet")
    try:
        found = tables.discover_days(spark, "quotes_test", dt.date(2023, 1, 1), dt.date(2023, 1, 31))
        assert sorted(r.date for r in found.collect()) == [DAY, DAY + dt.timedelta(days=1)]
        wanted = calendar.weekdays(spark, dt.date(2023, 1, 2), dt.date(2023, 1, 6))
        assert [r.date for r in calendar.existing_days(wanted, found).orderBy("date").collect()] == [DAY, DAY + dt.timedelta(days=1)]
    finally:
        spark.sql("DROP DATABASE quotes_test CASCADE")
    assert tables.discover_days(spark, "no_such_schema", dt.date(2023, 1, 2), dt.date(2023, 1, 8)).count() == 5


def test_daily_catalog_tables(spark, make_quotes):
    later = DAY + dt.timedelta(days=1)
    spark.sql("CREATE DATABASE IF NOT EXISTS daily_test")
    try:
        for day in (DAY, later):
            part = stored_quotes(make_quotes).filter(F.col("date") == F.lit(day)).drop("date")
            part.write.mode("overwrite").saveAsTable(f"daily_test.nbbom_{day:%Y%m%d}")
        both = tables.read_daily_tables(spark, "daily_test", DAY, dt.date(2023, 1, 31))
        assert sorted((r.symbol, r.date) for r in both.collect()) == [("AAA", DAY), ("AAA", DAY), ("BBB", later)]
        assert tables.read_daily_tables(spark, "daily_test", later, later, ["aaa"]).isEmpty()
        with pytest.raises(FileNotFoundError, match="daily_test"):
            tables.read_daily_tables(spark, "daily_test", dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    finally:
        spark.sql("DROP DATABASE daily_test CASCADE")


def test_bars_by_month_equal_bars_at_once(spark, make_quotes, tmp_path):
    from tickloom.operators.events import ofi_bars
    from tickloom.plans.dataset import extract_bars_by_month, extract_returns
    from test_events import random_quotes

    days = [dt.date(2022, 12, 30), dt.date(2023, 1, 3), dt.date(2023, 2, 1)]
    parts = [make_quotes(random_quotes(40, seed=i), day=d) for i, d in enumerate(days)]
    quotes = parts[0].unionByName(parts[1]).unionByName(parts[2])
    extract_bars_by_month(quotes, str(tmp_path / "bars"), days[0], days[2])
    assert rows_of(bar_files.read_bar_partitions(spark, str(tmp_path / "bars"))) == rows_of(ofi_bars(quotes))
    extract_returns(quotes, str(tmp_path / "returns"))
    assert bar_files.read_dataset(spark, str(tmp_path / "returns")).filter("bar_return is not null").count() > 0


def test_jdbc_predicates():
    later = DAY + dt.timedelta(days=1)
    assert quote_files.jdbc_day_predicates([later, DAY, DAY]) == ["date = DATE '2023-01-03'", "date = DATE '2023-01-04'"]


def test_calendar(spark):
    days = calendar.weekdays_of_year(spark, 2023)
    assert days.count() == 260
    available = days.filter(F.col("date") > F.lit(DAY))
    status = {r.date: r.status for r in calendar.reconcile_calendar(days, available, calendar.US_HOLIDAYS_2023).collect()}
    assert status[dt.date(2023, 1, 2)] == "holiday" and status[DAY] == "missing"
    assert status[dt.date(2023, 1, 4)] == "present" and dt.date(2023, 1, 7) not in status


def test_completeness(spark, make_bars):
    later = dt.date(2023, 1, 7)  # a Saturday
    bars = make_bars([("A", DAY, 1, 1.0), ("A", DAY, 2, 1.0), ("B", later, 1, 1.0)])
    days = spark.createDataFrame([(DAY,), (later,), (later,)], "date date")
    got = {(r.symbol, r.date): (r.n_bars, r.status) for r in calendar.completeness(bars, days, ["A", "B", "LOST", "A"]).collect()}
    assert got == {
        ("A", DAY): (2, "extracted"), ("A", later): (0, "skipped"), ("B", DAY): (0, "skipped"), ("B", later): (1, "extracted"),
        ("LOST", DAY): (0, "skipped"), ("LOST", later): (0, "skipped"),
    }


def test_packed_name_of_a_day_counts(spark):
    names = spark.createDataFrame([("nbbom_2024-01-03",), ("nbbom_20240103",), ("nbbom_2024-1-4",), ("nbbom_x",)], "table_name string")
    got = {r.date: r.table_name for r in calendar.dates_from_names(names).collect()}
    assert got == {dt.date(2024, 1, 3): "nbbom_20240103", dt.date(2024, 1, 4): "nbbom_2024-1-4"}


def test_event_quotes(spark):
    row = ("click", dt.datetime(2024, 1, 2, 9, 30, 0, 250_000))
    df = spark.createDataFrame(
        [(7, row[1], 13, row[0], 45.0, '{"k": 0}'), (8, row[1], 20, row[0], 5.0, '{"k": 99}')], quote_files.EVENT_SCHEMA
    )
    a, b = quote_files.quotes_from_events(df).orderBy("seq").collect()
    assert (a.time_ns, a.best_bid, a.best_bidsiz, a.best_ask, a.best_asksiz) == (34_200_250_000_000, 0.0, 4.0, 100.03, 1.0)
    assert (b.best_bid, b.best_ask, b.date) == (100.0, None, dt.date(2024, 1, 2))


def test_shared_folder_rules(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        settings.shared_dir(Session())
    assert settings.scratch_path(spark, "x") != settings.scratch_path(spark, "x")
    assert settings.shared_dir(spark) == settings.shared_dir(spark)


def test_daily_tables_of_many_layouts_are_one_source(spark, make_quotes, tmp_path):
    """Tables with equal columns share a scan, whatever their number; others keep their own."""
    spark.sql("CREATE DATABASE IF NOT EXISTS layouts_test")
    part = stored_quotes(make_quotes).filter(F.col("date") == F.lit(DAY)).drop("date")
    days = [DAY + dt.timedelta(days=i) for i in range(8)]

    def plan(until):
        df = tables.read_daily_tables(spark, "layouts_test", DAY, until)
        return df, df._jdf.queryExecution().executedPlan().toString()

    try:
        for day in days[:5]:
            part.write.parquet(str(tmp_path / f"at-{day}"))
            spark.sql(f"CREATE TABLE layouts_test.nbbom_{day:%Y%m%d} USING parquet LOCATION '{tmp_path}/at-{day}'")
        two, few = plan(days[1])
        five, more = plan(days[4])
        assert two.count() == 4 and five.count() == 10 and few.count("FileScan") == more.count("FileScan") == 1
        # Prices as decimals and whole numbers, a view, and a table cut further.
        odd = part.withColumns({"best_bid": F.expr("CAST(7.5 AS DECIMAL(10,2))"), "best_asksiz": F.lit(3)})
        odd.write.saveAsTable(f"layouts_test.nbbom_{days[5]:%Y%m%d}")
        spark.sql(f"CREATE VIEW layouts_test.nbbom_{days[6]:%Y%m%d} AS SELECT * FROM layouts_test.nbbom_{days[0]:%Y%m%d}")
        part.write.partitionBy("symbol").saveAsTable(f"layouts_test.nbbom_{days[7]:%Y%m%d}")
        everything, last = plan(days[7])
        rows = everything.collect()
        assert last.count("FileScan") == 4 and len(rows) == 16 and everything.dtypes == five.dtypes
        assert {(r.best_bid, r.best_asksiz) for r in rows if r.date == days[5]} == {(7.5, 3.0)}
        assert sorted({r.date for r in rows}) == days
    finally:
        spark.sql("DROP DATABASE layouts_test CASCADE")


def test_order_violations(spark, make_bars, tmp_path):
    rows = [(s, DAY + dt.timedelta(days=d), b, 1.0) for s in "ABC" for d in range(3) for b in range(4)]

    def counted(name):
        return tuple(bar_files.order_violations(spark, str(tmp_path / name)).first())

    bar_files.write_combined(make_bars(rows).repartition(5), str(tmp_path / "good"))
    assert counted("good") == (36, 0)
    # One pair of rows swapped within a file, and two files swapped.
    swapped = [*rows[:5], rows[6], rows[5], *rows[7:]]
    make_bars(swapped).coalesce(1).write.parquet(str(tmp_path / "swapped"))
    assert counted("swapped") == (36, 1)
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows[18:] + rows[:18])], "symbol string, date date, bucket int, ofi double, i int").repartitionByRange(
        2, "i"
    ).sortWithinPartitions("i").write.parquet(str(tmp_path / "files"))
    assert counted("files") == (36, 1)
    make_bars(sorted(rows, key=repr, reverse=True)).coalesce(1).write.parquet(str(tmp_path / "reversed"))
    assert counted("reversed") == (36, 35)
    make_bars([]).write.parquet(str(tmp_path / "empty"))
    assert counted("empty") == (0, 0)
    # A missing key comes first; equal keys are in order.
    make_bars([(None, DAY, 1, 1.0), ("A", DAY, 1, 1.0), ("A", DAY, 1, 2.0)]).coalesce(1).write.parquet(str(tmp_path / "nulls"))
    assert counted("nulls") == (3, 0)
    make_bars([("A", DAY, 1, 1.0), (None, DAY, 1, 1.0)]).coalesce(1).write.parquet(str(tmp_path / "late"))
    assert counted("late") == (2, 1)


def test_days_of_stored_quotes_open_no_file(spark, make_quotes, tmp_path):
    path = tmp_path / "quotes"
    stored_quotes(make_quotes).write.partitionBy("date").parquet(str(path))
    for name in ("date=2023-02-01", "date=none"):
        (path / name).mkdir()
        (path / name / "part-0.parquet").write_bytes(b"never opened")
    days = calendar.stored_days(spark, str(path))
    assert sorted(r.date for r in days.collect()) == [DAY, DAY + dt.timedelta(days=1), dt.date(2023, 2, 1)]


def test_bucketed_bars_need_no_exchange(spark, make_bars, tmp_path):
    from tickloom.plans.dataset import bucketed_dataset, modelling_dataset

    rows = [(s, DAY + dt.timedelta(days=d), b, float((d * 7 + b * 3) % 5)) for s in "ABCDE" for d in range(6) for b in range(5) if (d + b) % 4]
    splits = settings.SplitDates(DAY + dt.timedelta(days=2), DAY + dt.timedelta(days=3), DAY + dt.timedelta(days=3), DAY + dt.timedelta(days=4))
    bar_files.write_bucketed(make_bars(rows), "bucketed_test", 3, str(tmp_path / "bucketed"))
    try:
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = bucketed_dataset(spark.table("bucketed_test"), splits)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("Window") >= 1 and "SortMergeJoin" in plan
            rounded = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows_of(df)] for df in (got, modelling_dataset(make_bars(rows), splits))]
            assert rounded[0] == rounded[1]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    finally:
        spark.sql("DROP TABLE bucketed_test")


def test_bar_files_whose_types_drift(spark, make_bars, tmp_path):
    path = str(tmp_path / "bars")
    for kind, symbol in (("int", "A B"), ("long", "B"), ("double", "C%20")):
        rows = [(symbol, DAY + dt.timedelta(days=d), b, float(b) or float("nan")) for d in range(2) for b in range(3)]
        frame = make_bars(rows).withColumn("bucket", F.col("bucket").cast(kind))
        frame = frame.withColumn("n_events", F.lit(1)) if kind == "long" else frame
        written = bar_files.write_bar_files(frame.repartition(3), path).collect()
        assert sorted((r.symbol, r.date, r.n_bars) for r in written) == [(symbol, DAY, 3), (symbol, DAY + dt.timedelta(days=1), 3)]
    bar_files.write_bar_files(make_bars([("B", DAY, 9, 9.0), (None, DAY, 1, 1.0)]), path)
    assert bar_files.bar_file_layouts(spark, path).select("layout").distinct().count() == 3
    got = bar_files.read_bar_files(spark, path)
    assert dict(got.dtypes)["bucket"] == "int" and got.count() == 16
    assert {(r.bucket, r.n_events) for r in got.filter("symbol = 'B'").collect()} == {(9, None), (0, 1), (1, 1), (2, 1)}
    assert got.filter("ofi IS NULL").count() == 5
    (tmp_path / "bars" / "ofi5m_broken.parquet").write_bytes(b"PAR1 but no footer")
    with pytest.raises(ValueError, match="ofi5m_broken.parquet"):
        bar_files.read_bar_files(spark, path)
