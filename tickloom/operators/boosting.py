"""Boosted regression trees of many fits at once.

A fit is one experiment (features and a target) on one group of rows, such as a pair of
symbols. All fits grow together: each level of their trees is one aggregation, keyed by (fit,
node, feature, bin), so the number of jobs depends on trees and depth alone. Rows are kept as
blocks of bin numbers, which every experiment of a group shares.

The driver holds the splits of the trees that are not stored yet: fits * nodes, whatever the
number of rows. Groups come from an explicit list (the pairs of a suite).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import nan_to_null
from tickloom.settings import TARGET, materialize, scratch_path

MISSING = 255
BLOCK_ROWS = 1 << 16
# Trees between two writes of the running predictions.
STORED_EVERY = 10
_TRAIN, _TEST = 0, 1

_BLOCK_DDL = "gid int, n int, part binary, features binary, targets binary"
_STATE_DDL = "gid int, n int, part binary, bins binary, targets binary, pred binary"
_CELL_DDL = "fit int, node int, cells binary"
_SPLIT_DDL = "fit int, node int, n long, g long, feature int, bin int, nl long, gl long, gain double"
_PREDICTED_DDL = "gid int, number int, y double, p double"
_SPLIT = pa.schema(
    [
        ("fit", pa.int32()), ("node", pa.int32()), ("n", pa.int64()), ("g", pa.int64()), ("feature", pa.int32()),
        ("bin", pa.int32()), ("nl", pa.int64()), ("gl", pa.int64()), ("gain", pa.float64()),
    ]
)
_NODE = pa.schema(
    [
        ("gid", pa.int32()), ("number", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()),
        ("feature", pa.int32()), ("bin", pa.int32()), ("value", pa.float64()), ("gain", pa.float64()),
    ]
)


@dataclass(frozen=True)
class TreeParams:
    """100 trees of depth 4, learning rate 0.1, seed 42; leaves shrunk by ``l2``, splits
    that gain ``min_gain`` or less left out. The seed matters to Spark ML's trees alone.
    """

    n_estimators: int = 100
    max_depth: int = 4
    learning_rate: float = 0.1
    seed: int = 42
    max_bins: int = 256
    l2: float = 1.0
    min_gain: float = 1e-6


@dataclass(frozen=True)
class Experiment:
    name: str
    features: tuple[str, ...]
    target: str = TARGET


@dataclass(frozen=True)
class Layout:
    """Places of the experiments' features and targets in a block, and the depth of a tree."""

    features: tuple[tuple[int, ...], ...]
    targets: tuple[int, ...]
    n_features: int
    n_targets: int
    depth: int

    @property
    def nodes(self) -> int:
        return (1 << (self.depth + 1)) - 1


@dataclass
class Trees:
    """One tree of every fit as arrays of (fit, heap place of a node); feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, fit: int, columns: np.ndarray, depth: int) -> np.ndarray:
        """Place of the node that each row reaches within ``depth`` steps; ``columns`` are bins by feature.

        Goes node by node over whole columns, which costs a few vector operations a node and no
        gathering; children have higher places than their parent.
        """
        place = np.zeros(columns.shape[1], np.uint8 if self.feature.shape[1] <= 256 else np.int64)
        for at in range((1 << depth) - 1):
            feature = self.feature[fit, at]
            if feature >= 0:
                step = (columns[feature] > self.bin[fit, at]).astype(place.dtype) + place.dtype.type(at + 1)
                place += (place == at) * step
        return place


@dataclass(frozen=True)
class Fits:
    """What a task needs: which fits run, the unit of their residuals, and trees not yet added to ``pred``."""

    layout: Layout
    unit: np.ndarray
    active: np.ndarray
    trees: tuple[Trees, ...]


@dataclass(frozen=True)
class Boosted:
    """Result of ``boost``. ``predictions``: group, experiment, y and p of the test rows. ``nodes``: the
    trees, for :mod:`tickloom.operators.forest`. ``facts``: one row per fit with its number of training rows.
    """

    predictions: DataFrame
    nodes: DataFrame
    facts: DataFrame


def _raw_blocks(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[pa.RecordBatch]:
    """Rows of one group after another as blocks of numbers; missing values are NaN."""

    def block(gid: int, held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        part, features, targets = rows[:, 0].astype(np.uint8), rows[:, 1 : n_features + 1], rows[:, n_features + 1 :]
        columns = [[gid], [len(rows)], [part.tobytes()], [features.tobytes()], [targets.tobytes()]]
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = ["gid", "n", "part", "features", "targets"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    held: list[np.ndarray] = []
    current, count = None, 0
    for batch in batches:
        gids = batch.column(0).to_numpy()
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]], axis=1)
        cuts = np.flatnonzero(np.diff(gids)) + 1
        for gid, run in zip(gids[np.concatenate([[0], cuts])] if len(gids) else (), np.split(rows, cuts)):
            if held and (gid != current or count + len(run) > BLOCK_ROWS):
                yield block(current, held)
                held, count = [], 0
            current = int(gid)
            held.append(run)
            count += len(run)
    if held:
        yield block(current, held)


def _binned(batches: Iterator[pa.RecordBatch], layout: Layout, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks with every feature as the number of its group's edges below it."""
    experiments = len(layout.targets)
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            gid, n = one.column("gid")[0].as_py(), one.column("n")[0].as_py()
            raw = np.frombuffer(one.column("features")[0].as_py()).reshape(n, layout.n_features)
            edges = one.column("edges")[0].as_py()
            bins = np.full(raw.shape, MISSING, np.uint8)
            for f in range(layout.n_features):
                there = ~np.isnan(raw[:, f])
                bins[there, f] = np.searchsorted(np.array(edges[f], np.float64), raw[there, f], side="left")
            pred = np.tile(start[gid * experiments : (gid + 1) * experiments], (n, 1))
            kept = [one.column(c) for c in ("gid", "n", "part")]
            more = [pa.array([bins.tobytes()], pa.binary()), one.column("targets"), pa.array([pred.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=["gid", "n", "part", "bins", "targets", "pred"])


def _blocks(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[tuple]:
    """``gid`` and the arrays part, bins, targets and pred of one block after another."""
    for batch in batches:
        for gid, n, *packed in zip(*(batch.column(c).to_pylist() for c in ("gid", "n", "part", "bins", "targets", "pred"))):
            kinds = ((np.uint8, 1), (np.uint8, layout.n_features), (np.float64, layout.n_targets), (np.float64, len(layout.targets)))
            arrays = [np.frombuffer(data, kind).reshape(n, width) for data, (kind, width) in zip(packed, kinds)]
            yield gid, n, arrays[0][:, 0], *arrays[1:]


def _fit_rows(layout: Layout, number: int, part: np.ndarray, wanted: int, columns: np.ndarray, targets: np.ndarray):
    """Complete rows of one experiment in a block: their places, bins by feature, and targets."""
    own, y = columns[list(layout.features[number])], targets[:, layout.targets[number]]
    rows = np.flatnonzero((part == wanted) & (own != MISSING).all(axis=0) & ~np.isnan(y))
    return rows, own.take(rows, axis=1), y[rows]


def _predicted(fits: Fits, fit: int, columns: np.ndarray, pred: np.ndarray) -> np.ndarray:
    for tree in fits.trees:
        pred = pred + tree.value[fit].take(tree.leaves(fit, columns, fits.layout.depth))
    return pred


def _cells(batches: Iterator[pa.RecordBatch], fits: Fits, grown: Trees, level: int) -> Iterator[pa.RecordBatch]:
    """Rows and residuals of a task, one row per fit and node of the level.

    ``cells`` holds two numbers, rows and residuals, for each of 256 bins of each feature.
    Residuals are whole multiples of the fit's unit, so their sums don't depend on the partitions.
    """
    layout, experiments = fits.layout, len(fits.layout.targets)
    first, width = (1 << level) - 1, 1 << level

    def flushed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for fit, cells in sums.items():
            used = np.flatnonzero(cells[0, 0].reshape(width, 256).any(axis=1))
            packed = [np.ascontiguousarray(cells.reshape(-1, 2, width, 256)[:, :, node]).tobytes() for node in used]
            columns = [pa.array(np.full(len(used), fit, np.int32)), pa.array((first + used).astype(np.int32)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["fit", "node", "cells"])

    current, sums = None, {}
    for gid, _, part, bins, targets, pred in _blocks(batches, layout):
        if gid != current:
            yield from flushed(sums)
            current, sums = gid, {}
        columns = np.ascontiguousarray(bins.T)
        for number in range(experiments):
            fit = gid * experiments + number
            if not fits.active[fit]:
                continue
            rows, own, y = _fit_rows(layout, number, part, _TRAIN, columns, targets)
            residual = np.rint((y - _predicted(fits, fit, own, pred[rows, number])) / fits.unit[fit])
            node = grown.leaves(fit, own, level).astype(np.int64) - first
            if (node < 0).any():
                open_ = np.flatnonzero(node >= 0)
                own, node, residual = own.take(open_, axis=1), node[open_], residual[open_]
            keys = node << 8
            cells = np.empty((len(own), 2, width << 8), np.int64)
            for feature, column in enumerate(own):
                at = keys + column
                cells[feature, 0] = np.bincount(at, minlength=width << 8)
                # Below 2^53 for a block, hence exact.
                cells[feature, 1] = np.bincount(at, residual, width << 8)
            if fit in sums:
                sums[fit] += cells
            else:
                sums[fit] = cells
    yield from flushed(sums)


def _added(batches: Iterator[pa.RecordBatch], fits: Fits) -> Iterator[pa.RecordBatch]:
    """Blocks with the fits' trees added to ``pred``."""
    layout, experiments = fits.layout, len(fits.layout.targets)
    for gid, n, part, bins, targets, pred in _blocks(batches, layout):
        pred, by_feature = pred.copy(), np.ascontiguousarray(bins.T)
        for number in range(experiments):
            fit = gid * experiments + number
            if fits.active[fit]:
                own = by_feature[list(layout.features[number])]
                pred[:, number] = _predicted(fits, fit, own, pred[:, number])
        columns = ([gid], [n], [part.tobytes()], [bins.tobytes()], [targets.tobytes()], [pred.tobytes()])
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        names = ["gid", "n", "part", "bins", "targets", "pred"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _test_rows(batches: Iterator[pa.RecordBatch], fits: Fits) -> Iterator[pa.RecordBatch]:
    layout, experiments = fits.layout, len(fits.layout.targets)
    for gid, _, part, bins, targets, pred in _blocks(batches, layout):
        columns = np.ascontiguousarray(bins.T)
        for number in range(experiments):
            fit = gid * experiments + number
            if fits.active[fit]:
                rows, own, y = _fit_rows(layout, number, part, _TEST, columns, targets)
                p = _predicted(fits, fit, own, pred[rows, number])
                arrays = [pa.array(np.full(len(rows), k, np.int32)) for k in (gid, number)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(y), pa.array(p)], names=["gid", "number", "y", "p"])


def _node_splits(batches: Iterator[pa.RecordBatch], l2: float) -> Iterator[pa.RecordBatch]:
    """The best split of every node from its cells, which come sorted by fit and node.

    A node of n rows with residuals g is worth g * g / (n + l2) before it is split. Equal gains go
    to the earlier feature and the lower bin; ``feature`` is null where there is no split.
    """

    def best(key: tuple[int, int], cells: np.ndarray) -> tuple:
        counted, summed = cells.reshape(-1, 2, 256).transpose(1, 0, 2)
        nl, gl = counted.cumsum(axis=1), summed.cumsum(axis=1)
        n, g = int(nl[0, -1]), int(gl[0, -1])
        left, right, whole = gl.astype(np.float64), (g - gl).astype(np.float64), float(g)
        with np.errstate(divide="ignore", invalid="ignore"):  # of places that are no splits
            gain = left * left / (nl + l2) + right * right / (n - nl + l2) - whole * whole / (n + l2)
        gain = np.where((counted > 0) & (nl < n), gain, -np.inf)
        feature, bin_ = divmod(int(gain.argmax()), 256)
        if gain[feature, bin_] == -np.inf:
            return (*key, n, g, *[None] * 5)
        return (*key, n, g, feature, bin_, int(nl[feature, bin_]), int(gl[feature, bin_]), float(gain[feature, bin_]))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _SPLIT)], schema=_SPLIT)

    key, cells = None, None
    for batch in batches:
        found = []
        for fit, node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            more = np.frombuffer(packed.as_buffer(), np.int64)
            if (fit, node) == key:
                cells = cells + more
                continue
            if key is not None:
                found.append(best(key, cells))
            key, cells = (fit, node), more.copy()
        if found:
            yield rows(found)
    if key is not None:
        yield rows([best(key, cells)])


def _best_splits(cells: DataFrame, l2: float) -> DataFrame:
    """Per (fit, node): rows ``n``, residuals ``g`` and the split of most gain. Rows move once."""
    keys = ("fit", "node")
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_node_splits, l2=float(l2)), _SPLIT_DDL)


def _grow(state: DataFrame, fits: Fits, params: TreeParams) -> tuple[Trees, np.ndarray, np.ndarray]:
    """The next tree of all fits, its nodes' gains, and which nodes exist; one job a level."""
    shape = (len(fits.unit), fits.layout.nodes)
    tree = Trees(np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.zeros(shape))
    n, g, gain = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape)
    for level in range(fits.layout.depth):
        cells = state.mapInArrow(partial(_cells, fits=fits, grown=tree, level=level), _CELL_DDL)
        split = False
        for row in _best_splits(cells, params.l2).collect():
            at = (row.fit, row.node)
            n[at], g[at] = row.n, row.g
            worth = row.gain * fits.unit[row.fit] ** 2 if row.gain is not None else 0.0
            if worth > params.min_gain:
                split = True
                tree.feature[at], tree.bin[at], gain[at] = row.feature, row.bin, worth
                left, right = (row.fit, 2 * row.node + 1), (row.fit, 2 * row.node + 2)
                n[left], g[left] = row.nl, row.gl
                n[right], g[right] = row.n - row.nl, row.g - row.gl
        if not split:
            break
    leaf = (tree.feature < 0) & (n > 0)
    tree.value[leaf] = (params.learning_rate * fits.unit[:, None] * g / (n + params.l2))[leaf]
    return tree, gain, n > 0


def _node_rows(trees: Sequence[tuple[int, Trees, np.ndarray, np.ndarray]], layout: Layout) -> pa.Table:
    """Nodes of some trees as rows; ``feature`` is its place in the block, or -1."""
    experiments = len(layout.targets)
    places = [np.array([*f, -1], np.int32) for f in layout.features]
    parts = []
    for number, tree, gain, exists in trees:
        fit, node = np.nonzero(exists)
        own = tree.feature[fit, node]
        feature = np.array([places[f % experiments][k] for f, k in zip(fit, own)], np.int32)
        columns = (fit // experiments, fit % experiments, np.full(len(fit), number), node, feature, tree.bin[fit, node])
        columns = [pa.array(c.astype(np.int32)) for c in columns] + [pa.array(a[fit, node]) for a in (tree.value, gain)]
        parts.append(pa.Table.from_arrays(columns, schema=_NODE))
    return pa.concat_tables(parts)


def boost(
    frame: DataFrame,
    experiments: Sequence[Experiment],
    by: Sequence[str] = (),
    params: TreeParams = TreeParams(),
    min_train_rows: int = 1,
) -> Boosted:
    """Fit every experiment on the train rows of every group and predict its test rows.

    Squared error; trees start from the mean target. Candidate splits are the approximate
    quantiles of a feature over the group's train rows. Rows that miss a feature or the target
    of an experiment don't count for it. Fits with fewer than ``min_train_rows`` train rows are left out.
    """
    spark, by = frame.sparkSession, list(by)
    features = list(dict.fromkeys(f for e in experiments for f in e.features))
    targets = list(dict.fromkeys(e.target for e in experiments))
    layout = Layout(
        tuple(tuple(features.index(f) for f in e.features) for e in experiments),
        tuple(targets.index(e.target) for e in experiments),
        len(features), len(targets), params.max_depth,
    )
    part = F.when(F.col("split") == "train", _TRAIN).when(F.col("split") == "test", _TEST)
    values = [nan_to_null(F.col(c).cast("double")).alias(c) for c in dict.fromkeys([*features, *targets])]
    rows = frame.filter(F.col("split").isin("train", "test")).select(*by, part.alias("part"), *values)
    rows = materialize(rows, "fit-rows")
    train = rows.filter(F.col("part") == _TRAIN)

    measures = []
    for number, e in enumerate(experiments):
        whole = F.lit(True)
        for c in (*e.features, e.target):
            whole = whole & F.col(c).isNotNull()
        y = F.when(whole, F.col(e.target))
        measures += [F.count(y).alias(f"n{number}"), F.avg(y).alias(f"mean{number}"), F.max(F.abs(y)).alias(f"most{number}")]
    # One row per group; groups come from an explicit list.
    groups = sorted(train.groupBy(*by).agg(*measures).collect(), key=lambda r: tuple(map(str, r[: len(by)])))
    facts = np.array([[r[f"{c}{k}"] or 0.0 for c in ("n", "mean", "most")] for r in groups for k in range(len(experiments))], float)
    facts = facts.reshape(-1, 3)
    active = facts[:, 0] >= max(min_train_rows, 1)
    start = np.where(active, facts[:, 1].astype(np.float32), 0.0).astype(np.float64)
    unit = np.array([2.0 ** (math.frexp(2 * most)[1] - 30) if most else 1.0 for most in facts[:, 2]])
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    gids = spark.createDataFrame([(*r[: len(by)], i) for i, r in enumerate(groups)], f"{keys}, gid int".removeprefix(", "))

    numbered = rows.join(gids, by) if by else rows.withColumn("gid", F.lit(0))
    # Blocks get rows of few groups, and a group's rows many tasks.
    placed = numbered.repartitionByRange("gid", F.xxhash64(*features)).sortWithinPartitions("gid")
    blocks = placed.select("gid", "part", *features, *targets).mapInArrow(partial(_raw_blocks, n_features=len(features)), _BLOCK_DDL)
    cuts = F.array(*(F.lit(k / (MISSING - 1)) for k in range(1, MISSING - 1)))
    edges = F.array(*(F.coalesce(F.array_distinct(F.percentile_approx(f, cuts, 10_000)), F.array().cast("array<double>")) for f in features))
    grouped = numbered.filter(F.col("part") == _TRAIN).groupBy("gid").agg(edges.alias("edges"))
    edges = materialize(grouped, "edges")
    state = materialize(blocks.join(edges, "gid").mapInArrow(partial(_binned, layout=layout, start=start), _STATE_DDL), "boosting")

    nodes_path = scratch_path(spark, "forest")
    fits, pending = Fits(layout, unit, active, ()), []
    for number in range(params.n_estimators if active.any() else 0):
        tree, gain, exists = _grow(state, fits, params)
        pending.append((number, tree, gain, exists))
        fits = Fits(layout, unit, active, (*fits.trees, tree))
        if len(pending) == STORED_EVERY or number == params.n_estimators - 1:
            spark.createDataFrame(_node_rows(pending, layout)).write.mode("append").parquet(nodes_path)
            state = materialize(state.mapInArrow(partial(_added, fits=fits), _STATE_DDL), "boosting")
            fits, pending = Fits(layout, unit, active, ()), []

    names = spark.createDataFrame([(k, e.name) for k, e in enumerate(experiments)], "number int, experiment string")
    shown = gids if by else spark.range(1).select(F.col("id").cast("int").alias("gid"))
    predictions = state.mapInArrow(partial(_test_rows, fits=fits), _PREDICTED_DDL)
    predictions = predictions.join(shown, "gid").join(names, "number").select(*by, "experiment", "y", "p")
    stored = spark.createDataFrame([], _node_schema()) if not active.any() else spark.read.parquet(nodes_path)
    threshold = F.try_element_at(F.get("edges", F.col("feature")), F.col("bin") + 1)
    nodes = stored.join(edges, "gid", "left").join(shown, "gid").join(names, "number").select(
        *by, "experiment", "tree", "node",
        F.get(F.array(*(F.lit(f) for f in features)), F.col("feature")).alias("feature"),
        F.when(F.col("feature") >= 0, threshold).alias("threshold"), "value", "gain",
    )
    fitted = [
        (*groups[i // len(experiments)][: len(by)], experiments[i % len(experiments)].name, int(facts[i, 0]), float(start[i]))
        for i in np.flatnonzero(active)
    ]
    told = spark.createDataFrame(fitted, f"{keys}, experiment string, n_train long, start double".removeprefix(", "))
    return Boosted(predictions, nodes, told)


def _node_schema() -> str:
    return "gid int, number int, tree int, node int, feature int, bin int, value double, gain double"
