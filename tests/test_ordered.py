import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ordered


def history(seed, keys=("x", "y"), days=9, bars=7):
    rng = random.Random(seed)
    rows = []
    for k in keys:
        for d in range(days):
            for b in range(bars):
                if rng.random() < 0.7:
                    rows.append((k, dt.date(2024, 1, 1) + dt.timedelta(days=d), b, float(rng.randrange(100))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_rows", [3, 10, 100_000])
def test_shifts_equal_pandas_shifts(make_bars, chunk_rows):
    rows = history(1)
    shifts = {"lag1": ("ofi", 1), "lag3": ("ofi", 3), "next": ("ofi", -1), "later": ("ofi", -2)}
    got = ordered.shift_columns(make_bars(rows), ["symbol"], shifts, chunk_rows).toPandas()
    got = got.sort_values(["symbol", "date", "bucket"]).reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["symbol", "date", "bucket", "ofi"]).sort_values(["symbol", "date", "bucket"])
    want = want.reset_index(drop=True)
    for name, (column, k) in shifts.items():
        expected = want.groupby("symbol")[column].shift(k)
        assert np.array_equal(got[name].astype(float), expected.astype(float), equal_nan=True), name


@pytest.mark.parametrize("max_rows", [5, 10**9])
def test_row_positions_are_exact(spark, max_rows):
    rows = [("a" if i % 3 else "b", i // 10, i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t int, seq int").repartition(5)
    got = ordered.row_positions(df, ["k"], ["t", "seq"], max_rows).toPandas()
    for _, group in got.groupby("k"):
        group = group.sort_values(["t", "seq"])
        assert group.from_start.tolist() == list(range(1, len(group) + 1))
        assert group.from_end.tolist() == list(range(len(group), 0, -1))


def test_hot_groups_are_cut_and_cold_ones_are_not(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), "id")
    sliced, piece = ordered.split_hot_groups(df, ["k"], ["id"], 100)
    assert piece == ["k", "slice"]
    sizes = sliced.groupBy("k", "slice").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).toPandas()
    hot = sizes[sizes.k == "hot"].sort_values("slice")
    assert hot.n.max() <= 300 and hot.n.sum() == 900 and len(hot) > 5
    assert (hot.lo.values[1:] > hot.hi.values[:-1]).all()
    assert (sizes.k == "cold").sum() == 1
    same, keys = ordered.split_hot_groups(df, ["k"], ["id"], 1000)
    assert keys == ["k"] and same is df


@pytest.mark.parametrize("pieces", [1, 30, None])
def test_average_ranks_equal_pandas(spark, pieces):
    rng = random.Random(3)
    rows = [(g, float(rng.randrange(40))) for g in "ab" for _ in range(150)] + [("a", 7.0)] * 100
    df = spark.createDataFrame(rows, "g string, v double")
    got = ordered.average_ranks(df, ["g"], "v", pieces).toPandas()
    want = pd.DataFrame(rows, columns=["g", "v"])
    want["r"] = want.groupby("g").v.rank(method="average")
    merged = want.merge(got, on=["g", "v"])
    assert len(merged) == len(want) and np.allclose(merged.r, merged.avg_rank)


@pytest.mark.parametrize("pieces", [1, 30, None])
def test_quantiles_equal_numpy(spark, pieces):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.gauss(0, 1), 2.0])) for g in "ab" for _ in range(101)] + [("c", 5.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    got = {r.g: r for r in ordered.exact_quantiles(df, ["g"], "v", probabilities, pieces).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g and v is not None]
        for name, p in probabilities.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p)), (g, name)


def test_missing_days_and_groups_keep_their_rows(make_bars, spark):
    rows = [("x", None, 1, 1.0), ("x", dt.date(2024, 1, 1), 1, 2.0), ("x", dt.date(2024, 1, 1), 2, 3.0)]
    got = ordered.shift_columns(make_bars(rows), ["symbol"], {"lag1": ("ofi", 1)})
    assert sorted((r.ofi, r.lag1) for r in got.collect()) == [(1.0, None), (2.0, 1.0), (3.0, 2.0)]
    unnamed = ordered.shift_columns(make_bars([(None, *r[1:]) for r in rows]), ["symbol"], {"lag1": ("ofi", 1)})
    assert sorted((r.ofi, r.lag1) for r in unnamed.collect()) == [(1.0, None), (2.0, 1.0), (3.0, 2.0)]
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), ("g", 4.0)], "g string, v double")
    ranks = {(r.g, r.v): r.avg_rank for r in ordered.average_ranks(df, ["g"], "v").collect()}
    assert ranks == {(None, 1.0): 1.5, ("g", 4.0): 1.0}
