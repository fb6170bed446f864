import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tickloom.functions.stats import f_tail
from tickloom.operators import linear, pairs


@pytest.fixture(scope="module")
def dataset(spark):
    """Three symbols whose bars partly miss; b follows a by one bar."""
    rng = np.random.default_rng(5)
    rows = []
    base = rng.normal(size=401)
    for i in range(400):
        day, bucket = dt.date(2024, 1, 1) + dt.timedelta(days=i // 40), i % 40
        for symbol, value in (("a", base[i + 1]), ("b", 0.6 * base[i] + 0.5 * rng.normal()), ("c", 1.0)):
            if rng.random() < 0.95:
                rows.append((symbol, day, bucket, float(value), float(value), "train" if i < 250 else "test"))
    return spark.createDataFrame(rows, "symbol string, date date, bucket int, ofi double, ofi_z double, split string").persist()


@pytest.fixture(scope="module")
def wide(spark, dataset):
    table = pairs.pair_table(spark, [("a", "b"), ("a", "c"), ("a", "b")])
    return pairs.pair_bars(dataset, table, chunk_rows=50).persist()


def frame(wide, a, b):
    got = wide.filter((F.col("symbol_a") == a) & (F.col("symbol_b") == b)).toPandas()
    return got.sort_values(["date", "bucket"]).reset_index(drop=True)


def test_pair_join_is_an_inner_merge(dataset, wide):
    pdf = dataset.toPandas()
    merged = pdf[pdf.symbol == "a"].merge(pdf[pdf.symbol == "b"], on=["date", "bucket"]).sort_values(["date", "bucket"])
    got = frame(wide, "a", "b")
    assert len(got) == len(merged) and np.allclose(got.a_ofi_z, merged.ofi_z_x) and np.allclose(got.b_ofi_z, merged.ofi_z_y)
    for k in (1, 2, 3, 6):
        assert np.allclose(got[f"a_lag{k}"], got.a_ofi_z.shift(k), equal_nan=True)
    assert np.allclose(got.b_next, got.b_ofi_z.shift(-1), equal_nan=True)


def test_pair_lists_are_joined_without_a_hint(spark, dataset):
    joined = pairs.pair_join(dataset, pairs.pair_table(spark, [("a", "b"), ("c", "a")]), {"ofi": "ofi"})
    assert "strategy=broadcast" not in joined._jdf.queryExecution().analyzed().toString()


def test_correlations(wide):
    got = frame(wide, "a", "b")
    both = {(r.symbol_a, r.symbol_b): r.correlation for r in pairs.contemporaneous_corr(wide).collect()}
    assert both[("a", "b")] == pytest.approx(got.a_ofi_z.corr(got.b_ofi_z)) and both[("a", "c")] is None
    table = {(r.symbol_b, r.direction, r.lag): r for r in pairs.lead_lag_corr(wide).collect()}
    assert len(table) == 16
    for k in (1, 2, 3, 6):
        assert table[("b", "a_leads_b", k)].correlation == pytest.approx(got.a_ofi_z.shift(k).corr(got.b_ofi_z))
        assert table[("b", "b_leads_a", k)].correlation == pytest.approx(got.b_ofi_z.shift(k).corr(got.a_ofi_z))
    assert pairs.contemporaneous_corr(wide, min_rows=10_000).isEmpty()


def test_autocorrelation(dataset):
    pdf = dataset.filter("symbol = 'b'").toPandas().sort_values(["date", "bucket"])
    got = {(r.symbol, r.lag): r for r in pairs.autocorrelation(dataset, chunk_rows=40).collect()}
    for k in (1, 2, 3, 6, 12, 24):
        assert got[("b", k)].correlation == pytest.approx(pdf.ofi_z.autocorr(k)), k
        assert got[("c", k)].correlation is None
    assert pairs.autocorrelation(dataset, min_rows=10_000).isEmpty()


def test_doubled_bars_inflate_autocorrelation_as_expected(dataset):
    one = {r.symbol: r.correlation for r in pairs.autocorrelation(dataset, [1]).collect()}
    two = {r.symbol: r.correlation for r in pairs.autocorrelation(dataset.unionByName(dataset), [1]).collect()}
    assert two["b"] == pytest.approx((1 + one["b"]) / 2, abs=0.01)


def least_squares_rss(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    return float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))


@pytest.mark.parametrize("lags", [[1], [1, 2, 3, 6]])
def test_granger_equals_least_squares(wide, lags):
    got = {(r.symbol_b, r.direction): r for r in linear.granger_tests(wide, lags).collect()}
    table = frame(wide, "a", "b").astype({f"{s}_lag{k}": float for s in "ab" for k in lags})
    for direction, cause, effect in (("a_to_b", "a", "b"), ("b_to_a", "b", "a")):
        y, own, other = f"{effect}_ofi_z", [f"{effect}_lag{k}" for k in lags], [f"{cause}_lag{k}" for k in lags]
        complete_r, complete_u = table[[y, *own]].dropna(), table[[y, *own, *other]].dropna()
        rss_r = least_squares_rss(complete_r[own].values, complete_r[y].values)
        rss_u = least_squares_rss(complete_u[own + other].values, complete_u[y].values)
        df1, df2 = len(lags), len(complete_u) - 2 * len(lags)
        f = ((rss_r - rss_u) / df1) / (rss_u / df2)
        row = got[("b", direction)]
        assert row.f_statistic == pytest.approx(f, rel=1e-6, abs=1e-9) and row.n == len(complete_u)
        assert row.p_value == pytest.approx(f_tail(f, df1, df2), abs=1e-9)
        assert row.significant_at_05 == (row.p_value < 0.05)
    assert got[("b", "a_to_b")].significant_at_05
    corrected = linear.granger_tests(wide, lags, intercept_in_df=True).filter("symbol_b = 'b'").first()
    assert corrected.f_statistic < got[("b", corrected.direction)].f_statistic


def test_pair_returns(spark, dataset):
    returns = dataset.select("symbol", "date", "bucket", (F.col("ofi") / 10).alias("bar_return"), F.lit(0.01).alias("avg_spread"))
    some = returns.filter("bucket <> 5")
    got = frame(pairs.pair_returns(dataset, some, pairs.pair_table(spark, [("a", "b")])), "a", "b")
    assert 5 not in set(got.bucket) and len(got) > 300
    assert np.allclose(got.a_ret_lag2, got.a_ret.shift(2), equal_nan=True)
    assert np.allclose(got.b_ofi_lag6, got.b_ofi_z.shift(6), equal_nan=True)
    assert np.allclose(got.a_ret_next, got.a_ret.shift(-1), equal_nan=True)


def test_ar_baselines_equal_least_squares(dataset):
    lagged = dataset.filter("symbol <> 'c'")
    from tickloom.operators.features import add_lags

    frame = add_lags(lagged).persist()
    got = {r.model: r for r in linear.ar_baselines(frame).collect()}
    pdf = frame.toPandas()
    for p, names in ((1, ["lag1"]), (3, ["lag1", "lag2", "lag3"]), (6, ["lag1", "lag2", "lag3", "lag6"])):
        clean = pdf[["split", "y_next", *names]].dropna()
        train, test = clean[clean.split == "train"], clean[clean.split == "test"]
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train[names]]), train.y_next, rcond=None)[0]
        error = test.y_next - np.column_stack([np.ones(len(test)), test[names]]) @ beta
        assert got[f"AR({p})"].mse == pytest.approx(float((error**2).mean()), rel=1e-6)
        assert got[f"AR({p})"].n_samples == len(test)
    assert pd.notna(got["AR(1)"].correlation)


def test_pair_analysis_job(spark, dataset, tmp_path):
    from tickloom.plans.analysis import pair_analysis

    pair_analysis(dataset, pairs.pair_table(spark, [("a", "b")]), str(tmp_path))
    assert spark.read.json(str(tmp_path / "correlation")).count() == 1
    assert spark.read.json(str(tmp_path / "lead_lag")).count() == 8
    assert spark.read.json(str(tmp_path / "granger")).count() == 2


def test_granger_reads_once_and_stands_large_means(spark, wide, tmp_path):
    shifted = wide.select(*(F.col(c) + 1e6 if t == "double" else F.col(c) for c, t in wide.dtypes)).toDF(*wide.columns)
    shifted.write.parquet(str(tmp_path / "wide"))
    tests = linear.granger_tests(spark.read.parquet(str(tmp_path / "wide")), [1, 2])
    assert tests._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    near = {(r.symbol_b, r.direction): r.f_statistic for r in linear.granger_tests(wide, [1, 2]).collect()}
    far = {(r.symbol_b, r.direction): r.f_statistic for r in tests.collect()}
    assert far.keys() == near.keys() and all(far[k] == pytest.approx(near[k], rel=1e-6) for k in near if near[k] is not None)
