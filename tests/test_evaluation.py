import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.stats import f_tail
from tickloom.operators import evaluation
from tickloom.sources import metrics as metric_files


def predictions(spark, rows):
    return spark.createDataFrame([("m", y, p) for y, p in rows], "model string, y double, p double")


def scores(spark, rows):
    return evaluation.prediction_metrics(predictions(spark, rows), ["model"]).first()


def test_metrics_golden(spark):
    m = scores(spark, [(1.0, 2.0), (-1.0, -1.0), (0.0, 1.0), (2.0, -2.0), (float("nan"), 1.0), (1.0, None)])
    assert (m.mse, m.mae, m.n_samples) == pytest.approx((4.5, 1.5, 4))
    assert m.directional_accuracy == pytest.approx(2 / 3)
    assert m.correlation == pytest.approx(np.corrcoef([1, -1, 0, 2], [2, -1, 1, -2])[0, 1])


def test_constant_prediction_has_no_correlation(spark):
    assert scores(spark, [(1.0, 3.0), (2.0, 3.0)]).correlation is None


def test_no_rows_left(spark):
    m = scores(spark, [(None, 1.0), (float("nan"), 2.0)])
    assert (m.mse, m.mae, m.correlation, m.directional_accuracy, m.n_samples) == (None, None, None, None, 0)


@pytest.mark.parametrize("pieces", [1, 20, None])
def test_rank_ic(spark, pieces):
    golden = [(1.0, 1.0), (2.0, 2.0), (2.0, 5.0), (4.0, 3.0)]
    row = evaluation.rank_ic(predictions(spark, golden), ["model"], pieces=pieces).first()
    assert row.information_coefficient == pytest.approx(0.632455532)
    flat = evaluation.rank_ic(predictions(spark, [(1.0, 3.0), (2.0, 3.0)]), ["model"], pieces=pieces).first()
    assert flat.information_coefficient == 0.0


def test_rank_ic_equals_pandas(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 9, 400) / 4.0, rng.integers(-5, 9, 400) / 2.0
    df = predictions(spark, [(float(a), float(b)) for a, b in zip(y, p)])
    got = evaluation.rank_ic(df, ["model"], pieces=30).first().information_coefficient
    frame = df.toPandas()
    assert got == pytest.approx(frame.y.rank().corr(frame.p.rank()))


def metric_rows(spark, rows):
    return spark.createDataFrame(
        rows, "model string, ord int, mse double, mae double, correlation double, directional_accuracy double, n_samples long"
    )


def test_best_model_ties_and_missing_values(spark):
    nan = float("nan")
    rows = [("a", 1, 0.5, nan, None, 0.6, 3), ("b", 2, 0.5, 0.2, 0.1, 0.7, 3), ("c", 3, nan, 0.1, 0.3, 0.7, 3)]
    best = {r.metric: (r.best, r.value) for r in evaluation.best_models(metric_rows(spark, rows)).collect()}
    assert best == {"mse": ("a", 0.5), "mae": ("c", 0.1), "correlation": ("c", 0.3), "directional_accuracy": ("b", 0.7)}


def test_metrics_table(spark):
    row = evaluation.metrics_table(metric_rows(spark, [("trees", 1, 0.25, 0.5, None, 0.7916, 9)])).first()
    assert tuple(row) == ("TREES", "0.250000", "0.500000", "nan", "79.16%", 9)


def test_describe(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 2, 8])], "i int, v double")
    row = evaluation.describe_columns(df, ["v"]).first()
    assert (row["count"], row.mean, row.p25, row.p50, row.p75, row.max) == pytest.approx((4, 4.0, 1.75, 3.5, 5.75, 8.0))


def test_metric_records(spark, tmp_path):
    record = {
        "model": "trees", "timestamp": "2024-01-01T00:00:00", "params": {"n_estimators": 100, "best_epoch": 7},
        "feature_importance": {"lag1": 0.25, "ofi_z": 0.75},
        "test": {"mse": 0.5, "mae": 0.4, "correlation": float("nan"), "directional_accuracy": 0.6, "n_samples": 10},
        "history": {"train_loss": [3.0, 2.0], "val_loss": [4.0, 2.5]},
    }
    (tmp_path / "trees_metrics.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "other.json").write_text("{}")
    records = metric_files.read_metric_records(spark, str(tmp_path))
    assert records.count() == 1
    flat = metric_files.split_scores(records).first()
    assert (flat.model, flat.mse, flat.correlation, flat.n_samples) == ("trees", 0.5, None, 10)
    report = evaluation.model_report(records).first()
    assert (report.final_train_loss, report.final_val_loss, report.best_epoch) == (2.0, 2.5, "7")
    assert [r.feature for r in evaluation.importance_rows(records).collect()] == ["ofi_z", "lag1"]
    second = tmp_path / "copy.json"
    second.write_text(json.dumps({**record, "model": "later"}))
    paths = [str(second), str(tmp_path / "trees_metrics.json")]
    listed = metric_files.split_scores(metric_files.read_metric_records(spark, paths))
    assert evaluation.best_models(listed).filter("metric = 'mse'").first().best == "later"
    metric_files.write_metric_records(records.drop("ord"), str(tmp_path / "again_metrics.json"))
    assert metric_files.read_metric_records(spark, str(tmp_path)).count() == 2


def test_f_tail_known_values():
    # Upper 5 % and 1 % points of tabulated F distributions.
    for f, df1, df2, p in [(4.965, 1, 10, 0.05), (2.711, 5, 20, 0.05), (3.493, 2, 20, 0.05), (5.994, 4, 10, 0.01)]:
        assert f_tail(f, df1, df2) == pytest.approx(p, abs=1e-4)
    assert f_tail(0.0, 3, 9) == 1.0 and np.isnan(f_tail(float("nan"), 3, 9))
    x = 500 / (500 + 4 * 2.74)
    assert f_tail(2.74, 4, 500) == pytest.approx(x**250 * (1 + 250 * (1 - x)))


def test_dataset_profile(spark):
    rows = [("A", "train", 1.0), ("A", "train", None), ("B", "test", 2.0)]
    df = spark.createDataFrame(rows, "symbol string, split string, v double").withColumns(
        {"date": F.lit("2024-01-02").cast("date"), "y": F.lit(1.0)}
    )
    got = {(r.symbol, r.split): (r.n_rows, r.n_valid) for r in evaluation.dataset_profile(df, ["v"], "y").collect()}
    assert got == {("A", "train"): (2, 1), ("B", "test"): (1, 1)}
