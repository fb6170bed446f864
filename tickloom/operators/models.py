"""Boosted-tree regression and the runner the experiment suites share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.boosting import Experiment, TreeParams, boost
from tickloom.operators.evaluation import prediction_metrics, rank_ic
from tickloom.operators.features import complete_cases, present_columns
from tickloom.operators.forest import importance_shares
from tickloom.settings import FEATURES, TARGET, materialize, shared_dir


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_trees(
    train: DataFrame,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    params: TreeParams = TreeParams(),
) -> GBTRegressionModel:
    """Boosted regression trees on complete training rows.

    Trees grow level by level from binned histograms, aggregated on executors.
    """
    shared_dir(train.sparkSession)  # lets the fit checkpoint its running residuals
    rows = complete_cases(train, features, target).select(*dict.fromkeys((*features, target)))
    rows = materialize(rows, "training-rows")  # read once per level, in file-sized tasks
    trees = GBTRegressor(
        featuresCol="features",
        labelCol=target,
        predictionCol="p",
        maxIter=params.n_estimators,
        maxDepth=params.max_depth,
        stepSize=params.learning_rate,
        seed=params.seed,
        maxBins=params.max_bins,
    )
    return trees.fit(assemble(rows, features).select("features", target))


def predict(model: GBTRegressionModel, df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """Complete rows of ``df`` with the model's prediction ``p``."""
    return model.transform(assemble(complete_cases(df, features, target), features)).drop("features")


def importance_by_name(model: GBTRegressionModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, (float(v) for v in model.featureImportances.toArray())))


def evaluate_splits(model: GBTRegressionModel, dataset: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """Metrics on every labelled split in one pass."""
    scored = predict(model, dataset.filter(F.col("split") != "unknown"), features, target)
    return prediction_metrics(scored.withColumnRenamed(target, "y"), ["split"])


def save_model(model: GBTRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def run_experiments(
    frame: DataFrame,
    experiments: Sequence[Experiment],
    min_train_rows: int = 1,
    params: TreeParams = TreeParams(),
    with_rank_ic: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Fit each experiment on the train rows of each group ``by`` and score it on test rows.

    Wanted features that the frame lacks are left out, as are fits with fewer complete training
    rows than ``min_train_rows``. All fits grow in the same jobs. Result: the group, experiment,
    target, features, n_test, metrics and importance (mean gain of a feature's splits, as share).
    """
    by = list(by)
    resolved = [
        Experiment(e.name, tuple(present_columns(frame, e.features)), e.target)
        for e in experiments
        if e.target in frame.columns
    ]
    resolved = [e for e in resolved if e.features]
    boosted = boost(frame, resolved, by, params, min_train_rows) if resolved else None
    if boosted is None or not boosted.facts.take(1):
        raise ValueError("no experiment has enough complete training rows")
    listed = frame.sparkSession.createDataFrame(
        [(e.name, e.target, list(e.features)) for e in resolved], "experiment string, target string, features array<string>"
    )
    keys = [*by, "experiment"]
    described = boosted.facts.select(*keys).join(listed, "experiment")
    importance = importance_shares(boosted.nodes, keys)
    predictions = materialize(boosted.predictions, "predictions")
    metrics = prediction_metrics(predictions, keys)
    names = ["mse", "mae", "correlation", "directional_accuracy", "n_samples"]
    if with_rank_ic:
        metrics = metrics.join(rank_ic(predictions, keys), keys, "left")
        names.append("information_coefficient")
    shares = F.transform("features", lambda f: F.coalesce(F.try_element_at("shares", f), F.lit(0.0)))
    return described.join(metrics, keys, "left").join(importance, keys, "left").select(
        *keys,
        "target",
        "features",
        F.coalesce("n_samples", F.lit(0)).alias("n_test"),
        F.struct(*names).alias("metrics"),
        F.map_from_arrays("features", shares).alias("importance"),
    )
