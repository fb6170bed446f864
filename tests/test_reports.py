"""Suite and comparison documents through JSON and VARIANT."""

import json

import pytest

from tickloom.operators.evaluation import metric_records
from tickloom.plans import reports
from tickloom.sources import metrics as metric_files

RESULT = "a string, b string, experiment string, target string, features array<string>, n_test long, metrics struct<mse: double, mae: double, n_samples: long>, importance map<string,double>"


@pytest.fixture(scope="module")
def result(spark):
    rows = [
        ("x", "y", "one", "t", ["f", "g"], 5, (0.5, None, 5), {"f": 0.25, "g": 0.75}),
        ("x", "y", "two", "t", ["f"], 4, (1.5, 1.0, 4), {"f": 1.0}),
        ("x", "z", "one", "t", [], 0, (None, None, 0), None),
    ]
    return spark.createDataFrame(rows, RESULT)


def document(path):
    files = list(path.glob("*.json"))
    assert len(files) == 1
    return json.loads(files[0].read_text())


def test_a_suite_is_one_nested_document(spark, result, tmp_path):
    params = {"trees": {"depth": 4, "rate": 0.1}, "lags": [1, 2], "note": None}
    reports.write_suite(result.filter("b = 'y'").drop("a", "b"), str(tmp_path / "flat"), "told", params)
    written = document(tmp_path / "flat")
    assert written["params"] == params and written["description"] == "told" and "T" in written["timestamp"]
    assert written["experiments"]["one"] == {
        "target": "t", "features": ["f", "g"], "n_test": 5, "metrics": {"mse": 0.5, "mae": None, "n_samples": 5}, "importance": {"f": 0.25, "g": 0.75}
    }
    read = {"trees.depth": "int", "lags[1]": "long", "note": "string", "lags": "string"}
    rows = {r.experiment: r for r in reports.suite_rows(reports.read_documents(spark, str(tmp_path / "flat")), read).collect()}
    assert rows["one"].features == ["f", "g"] and rows["one"].importance == {"f": 0.25, "g": 0.75}
    assert (rows["one"].mse, rows["one"].mae, rows["two"].mae, rows["two"].n_samples) == (0.5, None, 1.0, 4)
    assert (rows["one"].trees_depth, rows["one"].lags_1, rows["one"].note) == (4, 2, None)


def test_a_suite_over_pairs_is_nested_once_more(spark, result, tmp_path):
    reports.write_suite(result, str(tmp_path / "pairs"), "pairs", by=["a", "b"])
    assert {k: sorted(v) for k, v in document(tmp_path / "pairs")["experiments"].items()} == {"x|y": ["one", "two"], "x|z": ["one"]}
    rows = reports.suite_rows(reports.read_documents(spark, str(tmp_path / "pairs")), grouped=True).collect()
    assert sorted((r.group_name, r.experiment, r.n_test) for r in rows) == [("x|y", "one", 5), ("x|y", "two", 4), ("x|z", "one", 0)]


def test_documents_written_by_hand(spark, tmp_path):
    text = {"description": 3, "experiments": {"e": {"n_test": "many", "metrics": {"mse": 1, "extra": [1]}}}, "params": "none"}
    (tmp_path / "hand.json").write_text(json.dumps(text, indent=2))
    row = reports.suite_rows(reports.read_documents(spark, str(tmp_path)), {"x": "int"}).first()
    assert (row.experiment, row.description, row.n_test, row.mse, row.mae, row.x) == ("e", "3", None, 1.0, None, None)


def test_comparison_keeps_models_and_winners(spark, tmp_path):
    scores = spark.createDataFrame(
        [("p", "test", 1.0, 2.0, 0.5, None, 3), ("q", "test", 1.0, 1.5, 0.7, None, 3), ("q", "train", 9.0, 9.0, 0.1, 0.2, 1)],
        "model string, split string, mse double, mae double, correlation double, directional_accuracy double, n_samples long",
    )
    metric_files.write_metric_records(metric_records(scores, {"depth": 4}), str(tmp_path / "m_metrics.json"))
    records = metric_files.read_metric_records(spark, str(tmp_path)).selectExpr("* EXCEPT (ord)", "model AS ord")
    reports.write_comparison(records, str(tmp_path / "comparison"))
    written = document(tmp_path / "comparison")
    assert [m["model"] for m in written["models"]] == ["p", "q"] and written["models"][1]["train"]["mse"] == 9.0
    rows = {r.metric: (r.best, r.value) for r in reports.comparison_rows(reports.read_documents(spark, str(tmp_path / "comparison"))).collect()}
    assert rows == {"mse": ("p", 1.0), "mae": ("q", 1.5), "correlation": ("q", 0.7)}
