import numpy as np
import pytest

from tickloom.operators import models
from tickloom.operators.models import Experiment, TreeParams
from tickloom.plans import suites
from tickloom.settings import FEATURES

QUICK = TreeParams(n_estimators=5, max_depth=3)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        x, noise = rng.normal(size=2)
        split = "train" if i < 250 else "val" if i < 320 else "test"
        rows.append((split, float(x), float(noise), None if i % 50 == 0 else float(2 * x + 0.1 * noise)))
    return spark.createDataFrame(rows, "split string, x double, noise double, y_next double").persist()


def test_trees_beat_the_mean_and_repeat_exactly(frame):
    train = frame.filter("split = 'train'")
    model = models.fit_trees(train, ["x", "noise"], params=QUICK)
    got = {r.split: r for r in models.evaluate_splits(model, frame, ["x", "noise"]).collect()}
    assert set(got) == {"train", "val", "test"} and got["test"].n_samples == 79
    variance = float(np.var([r.y_next for r in frame.dropna().filter("split = 'test'").collect()]))
    assert got["test"].mse < 0.5 * variance
    again = models.fit_trees(train, ["x", "noise"], params=QUICK)
    assert models.importance_by_name(again, ["x", "noise"]) == models.importance_by_name(model, ["x", "noise"])
    assert models.importance_by_name(model, ["x", "noise"])["x"] > 0.8


def test_model_sink(frame, tmp_path):
    model = models.fit_trees(frame, ["x"], params=QUICK)
    models.save_model(model, str(tmp_path / "m"))
    loaded = models.load_model(str(tmp_path / "m"))
    a, b = (sorted(r.p for r in models.predict(m, frame, ["x"]).collect()) for m in (model, loaded))
    assert a == b


def test_runner_contract(frame):
    experiments = [
        Experiment("both", ("x", "noise", "absent")),
        Experiment("nothing", ("absent",)),
        Experiment("no_target", ("x",), "absent"),
        Experiment("noise", ("noise",)),
    ]
    got = {r.experiment: r for r in models.run_experiments(frame, experiments, 100, QUICK, with_rank_ic=True).collect()}
    assert set(got) == {"both", "noise"}
    assert got["both"].features == ["x", "noise"] and set(got["both"].importance) == {"x", "noise"}
    assert got["both"].n_test == 79 and got["both"].metrics.information_coefficient > 0.8
    assert got["both"].metrics.mse < got["noise"].metrics.mse
    with pytest.raises(ValueError, match="training rows"):
        models.run_experiments(frame, experiments, 10_000, QUICK)


def test_suite_definitions():
    assert [len(f) for f in suites.ABLATIONS.values()] == [6, 5, 1, 1, 3]
    assert len(suites.CHANGE_SETS["all_features"]) == 10
    cross = {e.name: e for e in suites.cross_experiments()}
    assert set(cross) == {"a_to_b", "b_own", "b_from_both", "b_to_a", "a_own", "a_from_both"}
    assert cross["a_to_b"].features == ("a_ofi_z", "a_lag1", "a_lag2", "a_lag3") and cross["a_to_b"].target == "b_next"
    assert cross["a_from_both"].features == ("a_ofi_z", "a_lag1", "a_lag2", "b_ofi_z", "b_lag1", "b_lag2")
    price = {e.name: e for e in suites.price_experiments()}
    assert len(price) == 12 and len(price["b:price_plus_ofi_both"].features) == 16
    assert price["a:price_only_own"].target == "a_ret_next"
    assert suites.ABLATIONS["full_model"] == FEATURES


def test_training_job(spark, frame, tmp_path):
    from tickloom.plans.training import train_trees
    from tickloom.sources.metrics import read_metric_records, split_scores

    model = train_trees(frame, str(tmp_path / "trees_metrics.json"), str(tmp_path / "model"), ["x", "noise"], params=QUICK)
    records = read_metric_records(spark, str(tmp_path)).persist()
    record = records.first()
    assert record.params["n_estimators"] == "5" and record.feature_importance == models.importance_by_name(model, ["x", "noise"])
    want = {r.split: r.mse for r in models.evaluate_splits(model, frame, ["x", "noise"]).collect()}
    assert split_scores(records, "test").first().mse == pytest.approx(want["test"])
    assert split_scores(records, "validation").first().mse == pytest.approx(want["val"])
    assert models.load_model(str(tmp_path / "model")).getNumTrees == 5
