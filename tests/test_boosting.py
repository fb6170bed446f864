"""Shared boosting against one fit at a time in plain NumPy, and forests as data."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tickloom.operators import forest
from tickloom.operators.boosting import Experiment, Fits, Layout, TreeParams, Trees, _cells, boost

PARAMS = TreeParams(n_estimators=12, max_depth=3, min_gain=1e-6)
EXPERIMENTS = [Experiment("both", ("x", "z"), "y"), Experiment("one", ("z",), "y"), Experiment("other", ("z", "x", "w"), "v")]
SCHEMA = "pair string, split string, x double, z double, w double, y double, v double"


def rows_of(pair, seed, n):
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, z, w, noise = (float(v) for v in random.normal(size=4))
        x, w = round(x, 1), None if i % 11 == 0 else w
        y = None if i % 17 == 0 else math.sin(2 * x) + 0.3 * z + 0.1 * noise
        rows.append((pair, ("train", "train", "val", "test")[i % 4], x, float("nan") if i % 13 == 0 else z, w, y, 100.0 * (z + noise)))
    return rows


def brute(rows, experiment, params):
    """Predictions of the test rows by an exact greedy search over all values."""
    names = SCHEMA.replace(" string", "").replace(" double", "").split(", ")

    def table(split):
        keep = [names.index(c) for c in (*experiment.features, experiment.target)]
        found = [[r[k] for k in keep] for r in rows if r[1] == split]
        found = np.array([f for f in found if all(v is not None and not math.isnan(v) for v in f)], float).reshape(-1, len(keep))
        return found[:, :-1], found[:, -1]

    x, y = table("train")
    x_test, y_test = table("test")
    pred, pred_test = np.full(len(y), y.mean()), np.full(len(y_test), y.mean())

    def grow(inside, inside_test, residual, depth):
        g, n = residual[inside].sum(), inside.sum()
        best = (params.min_gain, None)
        for f in range(x.shape[1] if depth else 0):
            for cut in np.unique(x[inside, f])[:-1]:
                left = inside & (x[:, f] <= cut)
                gl, nl = residual[left].sum(), left.sum()
                gain = gl**2 / (nl + params.l2) + (g - gl) ** 2 / (n - nl + params.l2) - g**2 / (n + params.l2)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, cut))
        if best[1] is None:
            pred[inside] += params.learning_rate * g / (n + params.l2)
            pred_test[inside_test] += params.learning_rate * g / (n + params.l2)
            return
        f, cut = best[1]
        grow(inside & (x[:, f] <= cut), inside_test & (x_test[:, f] <= cut), residual, depth - 1)
        grow(inside & (x[:, f] > cut), inside_test & (x_test[:, f] > cut), residual, depth - 1)

    for _ in range(params.n_estimators):
        grow(np.ones(len(y), bool), np.ones(len(y_test), bool), y - pred, params.max_depth)
    return sorted(zip(y_test, pred_test))


@pytest.fixture(scope="module")
def rows():
    return rows_of("a", 1, 300) + rows_of("b", 2, 200) + rows_of("few", 3, 20)


@pytest.fixture(scope="module")
def boosted(spark, rows):
    return boost(spark.createDataFrame(rows, SCHEMA).repartition(5), EXPERIMENTS, ["pair"], PARAMS, min_train_rows=40)


def test_equals_single_fits_in_numpy(boosted, rows):
    got = {}
    for r in boosted.predictions.collect():
        got.setdefault((r.pair, r.experiment), []).append((r.y, r.p))
    assert set(got) == {(p, e.name) for p in "ab" for e in EXPERIMENTS}
    for (pair, name), found in got.items():
        experiment = next(e for e in EXPERIMENTS if e.name == name)
        want = brute([r for r in rows if r[0] == pair], experiment, PARAMS)
        assert np.allclose(sorted(found), want, rtol=1e-5, atol=1e-6)


def test_partitions_and_other_fits_change_nothing(spark, boosted, rows):
    def listed(result):
        return sorted(map(tuple, result.predictions.filter("pair = 'a' AND experiment = 'both'").collect()))

    alone = boost(spark.createDataFrame([r for r in rows if r[0] == "a"], SCHEMA).coalesce(1), EXPERIMENTS[:1], ["pair"], PARAMS)
    assert np.allclose([r[2:] for r in listed(alone)], [r[2:] for r in listed(boosted)], rtol=1e-7, atol=1e-9)
    ungrouped = boost(spark.createDataFrame([r for r in rows if r[0] == "a"], SCHEMA), EXPERIMENTS[:1], [], PARAMS)
    assert ungrouped.predictions.columns == ["experiment", "y", "p"]
    assert np.allclose(sorted(map(tuple, ungrouped.predictions.select("y", "p").collect())), [r[2:] for r in listed(alone)], rtol=1e-7, atol=1e-9)


def test_jobs_depend_on_trees_and_depth_alone(spark, rows):
    def jobs(frame, experiments, group):
        spark.sparkContext.setJobGroup(group, group)
        boost(frame, experiments, ["pair"], TreeParams(n_estimators=3, max_depth=2))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    frame = spark.createDataFrame(rows, SCHEMA).persist()
    few = jobs(frame.filter("pair = 'a'"), EXPERIMENTS[:1], "one-fit")
    assert abs(jobs(frame, EXPERIMENTS, "many-fits") - few) <= 3


def test_forest_scores_as_the_fit_does(spark, boosted, rows, tmp_path):
    """The stored node table, as an expression and as SQL, gives the predictions of the fit."""
    chosen = boosted.nodes.filter("pair = 'a' AND experiment = 'other'").drop("pair", "experiment")
    forest.write_forest(chosen, str(tmp_path / "forest"))
    nodes = forest.read_forest(spark, str(tmp_path / "forest"), EXPERIMENTS[2].features)
    start = boosted.facts.filter("pair = 'a' AND experiment = 'other'").first().start
    test = spark.createDataFrame([r for r in rows if r[:2] == ("a", "test")], SCHEMA).replace(float("nan"), None)
    scored = test.select("v", forest.forest_column(nodes, start).alias("p"))
    want = sorted(map(tuple, boosted.predictions.filter("pair = 'a' AND experiment = 'other'").select("y", "p").collect()))
    assert np.allclose(sorted(map(tuple, scored.dropna().collect())), want, rtol=1e-12)
    by_sql = test.selectExpr("v", f"{forest.forest_sql(nodes, start)} AS p")
    assert sorted(map(repr, by_sql.collect())) == sorted(map(repr, scored.collect()))
    assert scored.filter("p IS NULL").count() > 0
    with pytest.raises(ValueError, match="unknown features"):
        forest.read_forest(spark, str(tmp_path / "forest"), ["x"])
    forest.write_forest(chosen.filter("NOT (tree = 0 AND node = 2)"), str(tmp_path / "broken"))
    with pytest.raises(ValueError, match="lacks a child"):
        forest.read_forest(spark, str(tmp_path / "broken"), EXPERIMENTS[2].features)


def test_importance_is_the_mean_gain_as_share(spark, boosted):
    nodes = spark.createDataFrame(
        [("m", 0, 0, "x", 0.5, 0.0, 6.0), ("m", 0, 1, "x", 0.1, 0.0, 2.0), ("m", 0, 2, "z", 0.1, 0.0, 12.0), ("m", 0, 3, None, None, 1.0, 0.0)],
        f"model string, {forest.NODE_SCHEMA}",
    )
    assert forest.importance_shares(nodes, ["model"]).first().shares == {"x": 0.25, "z": 0.75}
    for r in forest.importance_shares(boosted.nodes, ["pair", "experiment"]).collect():
        assert sum(r.shares.values()) == pytest.approx(1)


def test_empty_and_flat_frames(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    nothing = boost(frame.limit(0), EXPERIMENTS, ["pair"], PARAMS)
    assert nothing.predictions.count() == nothing.nodes.count() == nothing.facts.count() == 0
    flat = boost(frame.selectExpr("pair", "split", "1D AS x", "z", "w", "2D AS y", "v"), EXPERIMENTS[:2], ["pair"], PARAMS)
    assert {r.p for r in flat.predictions.collect()} == {2.0}


def test_measured_gains_of_a_forest(spark):
    nodes = [
        {"tree": 0, "node": 0, "feature": "x", "threshold": 0.0, "value": 0.0},
        {"tree": 0, "node": 1, "feature": None, "threshold": None, "value": 1.0},
        {"tree": 0, "node": 2, "feature": "z", "threshold": 1.0, "value": 0.0},
        {"tree": 0, "node": 5, "feature": None, "threshold": None, "value": 2.0},
        {"tree": 0, "node": 6, "feature": None, "threshold": None, "value": 3.0},
        {"tree": 1, "node": 0, "feature": "z", "threshold": 9.0, "value": 0.0},
        {"tree": 1, "node": 1, "feature": None, "threshold": None, "value": 0.5},
        {"tree": 1, "node": 2, "feature": None, "threshold": None, "value": 0.5},
    ]
    data = [(-1.0, 0.0, 2.0), (0.0, 5.0, 4.0), (1.0, 1.0, 1.0), (2.0, 2.0, 7.0), (3.0, None, 9.0), (None, 0.0, 1.0), (1.0, 1.0, None)]
    rows = spark.createDataFrame(data, "x double, z double, y double")
    got = {(r.tree, r.node): (r.feature, r.n, r.gain) for r in forest.node_gains(rows, nodes, "y").collect()}
    assert got[0, 0] == ("x", 5, pytest.approx(36 / 2 + 289 / 3 - 529 / 5))
    assert got[0, 2] == ("z", 2, pytest.approx(1 + 49 - 32))
    # What tree 0 leaves over: 1, 3, -1, 4; no row goes right.
    assert got[1, 0] == ("z", 4, pytest.approx(0))
    assert forest.node_gains(rows.limit(0), nodes, "y").count() == 0


def test_a_task_sends_one_row_a_node_whatever_the_bins():
    random = np.random.default_rng(4)
    bins, y = random.integers(0, 254, (5000, 2)).astype(np.uint8), random.normal(size=(5000, 1))
    layout = Layout(((0, 1),), (0,), 2, 1, 2)
    columns = {"gid": [0], "n": [5000], "part": [bytes(5000)], "bins": [bins.tobytes()], "targets": [y.tobytes()], "pred": [bytes(8 * 5000)]}
    empty = Trees(np.full((1, 7), -1, np.int8), np.zeros((1, 7), np.uint8), np.zeros((1, 7)))
    empty.feature[0, 0], empty.bin[0, 0] = 1, 100
    fits = Fits(layout, np.array([2.0**-20]), np.array([True]), ())
    sent = pa.Table.from_batches(_cells(iter([pa.RecordBatch.from_pydict(columns)]), fits, empty, 1))
    assert sent.num_rows == 2
    for node, packed in zip(sent["node"].to_pylist(), sent["cells"].to_pylist()):
        cells = np.frombuffer(packed, np.int64).reshape(2, 2, 256)
        inside = (bins[:, 1] > 100) == (node == 2)
        for f in range(2):
            assert (cells[f, 0] == np.bincount(bins[inside, f], minlength=256)).all()
            assert (cells[f, 1] == np.bincount(bins[inside, f], np.rint(y[inside, 0] * 2.0**20), 256)).all()
