import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DAY, rows_of
from tickloom.functions import scalar as fn
from tickloom.operators import features
from tickloom.plans.dataset import modelling_dataset
from tickloom.settings import SplitDates
from test_ordered import history

DATES = SplitDates(dt.date(2023, 9, 30), dt.date(2023, 10, 1), dt.date(2023, 11, 30), dt.date(2023, 12, 1))
LATE = SplitDates(dt.date(2024, 1, 4), dt.date(2024, 1, 5), dt.date(2024, 1, 6), dt.date(2024, 1, 7))


def z(df):
    return [r.ofi_z for r in df.orderBy("symbol", "date", "bucket").collect()]


def test_daily_and_expanding_zscores(make_bars):
    bars = make_bars([("A", DAY, i, float(i + 1)) for i in range(3)])
    assert z(features.zscore_daily(bars)) == pytest.approx([-1, 0, 1])
    assert z(features.zscore_expanding(bars)) == pytest.approx([0, 1, 1.224744871])


def test_flat_and_single_bar_days_are_zero(make_bars):
    bars = make_bars([("A", DAY, 1, 5.0), ("A", DAY, 2, 5.0), ("B", DAY, 1, 3.0)])
    for method in (features.zscore_daily, features.zscore_expanding):
        assert z(method(bars)) == [0.0, 0.0, 0.0]


def test_training_zscore_sees_training_rows_only(make_bars):
    old, new = DATES.train_end, DATES.test_start
    rows = [("A", old, 1, 1.0), ("A", old, 2, 3.0), ("A", new, 1, 100.0), ("B", new, 1, 9.0)]
    got = z(features.zscore_training(make_bars(rows), DATES.train_end))
    sd = np.std([1, 3], ddof=1)
    assert got == pytest.approx([-1 / sd, 1 / sd, 98 / sd, 0.0])
    edited = [*rows[:2], ("A", new, 1, -5.0), rows[3]]
    assert z(features.zscore_training(make_bars(edited), DATES.train_end))[:2] == pytest.approx(got[:2])


def test_expanding_zscore_ignores_the_future(make_bars):
    rows = [("A", DAY, i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5])]
    assert z(features.zscore_expanding(make_bars(rows[:3]))) == pytest.approx(z(features.zscore_expanding(make_bars(rows)))[:3])


def test_lags_cross_midnight_unless_reset(make_bars):
    later = DAY + dt.timedelta(days=1)
    bars = make_bars([("A", DAY, 1, 1.0), ("A", DAY, 2, 2.0), ("A", later, 1, 3.0)]).withColumn("ofi_z", F.col("ofi"))
    rows = features.add_lags(bars, [1]).orderBy("date", "bucket").collect()
    assert [(r.lag1, r.y_next) for r in rows] == [(None, 2.0), (1.0, 3.0), (2.0, None)]
    daily = features.add_lags(bars, [1], reset_daily=True).orderBy("date", "bucket").collect()
    assert [(r.lag1, r.y_next) for r in daily] == [(None, 2.0), (1.0, None), (None, None)]


def test_split_labels(spark):
    days = [dt.date(2023, 9, 30), dt.date(2023, 10, 1), dt.date(2023, 11, 30), dt.date(2023, 12, 1), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, date date")
    labels = [r.split for r in features.add_split(df, DATES).orderBy("i").collect()]
    assert labels == ["train", "val", "val", "test", "unknown"]
    train, val, test = features.split_frames(features.add_split(df, DATES))
    assert (train.count(), val.count(), test.count()) == (1, 2, 1)


def test_doubled_bars_give_the_same_dataset(make_bars):
    rows = history(5)
    once = modelling_dataset(make_bars(rows), LATE)
    twice = modelling_dataset(make_bars(rows + rows), LATE)
    assert rows_of(once) == rows_of(twice)
    assert modelling_dataset(make_bars(rows + rows), LATE, dedup=False).count() == 2 * once.count()


def test_another_symbol_changes_nothing(make_bars):
    alone = modelling_dataset(make_bars([r for r in history(6) if r[0] == "x"]), LATE, "daily")
    together = modelling_dataset(make_bars(history(6)), LATE, "daily").filter("symbol = 'x'")
    assert rows_of(alone) == rows_of(together)


def test_target_is_the_next_rows_value(make_bars):
    rows = modelling_dataset(make_bars(history(7)), LATE, "expanding", chunk_rows=13).orderBy("symbol", "date", "bucket").collect()
    for here, there in zip(rows, rows[1:]):
        assert here.y_next == (there.ofi_z if here.symbol == there.symbol else None)


def test_unknown_normalization_is_refused(make_bars):
    with pytest.raises(ValueError, match="normalization"):
        modelling_dataset(make_bars(history(7)), LATE, "none")


def test_ofi_changes_equal_pandas(make_bars):
    bars = make_bars(history(8)).withColumn("ofi_z", F.col("ofi") / 7)
    got = features.add_ofi_changes(bars, chunk_rows=20).toPandas().sort_values(["symbol", "date", "bucket"]).reset_index(drop=True)
    grouped = got.groupby("symbol")
    assert np.allclose(got.ofi_change.astype(float), grouped.ofi.diff().astype(float), equal_nan=True)
    assert np.allclose(got.next_ofi_sign.astype(float), np.sign(grouped.ofi_z.shift(-1).astype(float)), equal_nan=True)
    change = grouped.ofi_z.diff()
    for k in (1, 2, 3, 6, 12):
        want = change.groupby(got.symbol).shift(k)
        assert np.allclose(got[f"ofi_change_lag{k}"].astype(float), want.astype(float), equal_nan=True), k


@pytest.mark.parametrize("chunk_rows", [3, 100_000])
def test_sequences(make_bars, chunk_rows):
    rows = [("A", DAY, i, float(i)) for i in range(5)]
    df = make_bars(rows).withColumns({"f": F.col("ofi") * 10, "y_next": F.col("ofi") + 0.5, "split": F.lit("train")})
    blocks = features.sliding_sequences(df, 2, ["ofi", "f"], chunk_rows=chunk_rows).orderBy("row_no").collect()
    assert [b.row_no for b in blocks] == [1, 2, 3]
    assert blocks[0].x == [[0.0, 0.0], [1.0, 10.0]] and blocks[0].y == 2.5
    assert features.sliding_sequences(df, 5, ["ofi", "f"], chunk_rows=chunk_rows).count() == 0
    shifted = features.sliding_sequences(df, 2, ["ofi", "f"], target_offset=1, chunk_rows=chunk_rows)
    assert [b.y for b in shifted.orderBy("row_no").collect()] == [1.5, 2.5, 3.5]


def test_incomplete_rows_leave_sequences(make_bars):
    df = make_bars([("A", DAY, i, None if i == 2 else float(i)) for i in range(6)])
    df = df.withColumns({"y_next": F.lit(1.0), "split": F.lit("train")})
    blocks = features.sliding_sequences(df, 2, ["ofi"]).orderBy("row_no").collect()
    assert [b.x for b in blocks] == [[[0.0], [1.0]], [[1.0], [3.0]], [[3.0], [4.0]]]


def test_bar_time(make_bars):
    row = features.add_bar_time(make_bars([("A", DAY, 114, 1.0)])).first()
    assert row.bar_time == "09:30" and row.datetime == dt.datetime(2023, 1, 3, 9, 30)
    assert features.present_columns(make_bars([("A", DAY, 1, 1.0)]), ["ofi", "nope", "date"]) == ["ofi", "date"]


def test_scalar_helpers(spark):
    texts = {
        "2023-01-03": DAY, "20230103": DAY, "2023-1-3": DAY, "2023-01-3": DAY, "202313": DAY, "2023113": dt.date(2023, 11, 3),
        "2023131": dt.date(2023, 1, 31), "202311": dt.date(2023, 1, 1), "2023230": None, "2023-02-30": None, "bad": None,
        "2023-13-01": None, "23-01-03": None, "": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert {r[0]: r[1] for r in df.select("s", fn.try_parse_date(F.col("s"))).collect()} == texts
    for text in ("bad", "2023-02-30"):
        with pytest.raises(Exception, match=f"cannot parse date: {text}"):
            df.filter(F.col("s") == text).select(fn.parse_date(F.col("s"))).collect()
    assert df.select(fn.date_key(F.lit(DAY))).first()[0] == "20230103"
    assert fn.clean_symbols([" aapl", "MSFT ", " "]) == ["AAPL", "MSFT"]
    texts = df.select(fn.fixed_decimals(F.lit(0.5), 6), fn.percent_text(F.lit(0.12345)), fn.percent_text(F.lit(None).cast("double"))).first()
    assert tuple(texts) == ("0.500000", "12.35%", "nan%") or tuple(texts) == ("0.500000", "12.34%", "nan%")
