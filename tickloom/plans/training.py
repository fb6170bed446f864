"""Job: fit boosted trees on a dataset, score every split, store model and metric record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import models
from tickloom.operators.evaluation import metric_records
from tickloom.settings import FEATURES, TARGET
from tickloom.sources.metrics import write_metric_records


def train_trees(
    dataset: DataFrame,
    metrics_path: str,
    model_path: str | None = None,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    params: models.TreeParams = models.TreeParams(),
    name: str = "trees",
) -> models.GBTRegressionModel:
    """The fitted model; ``dataset`` is read by the fit and by the scoring, so store it first."""
    model = models.fit_trees(dataset.filter(F.col("split") == "train"), features, target, params)
    scores = models.evaluate_splits(model, dataset, features, target).withColumn("model", F.lit(name))
    importance = models.importance_by_name(model, features)
    write_metric_records(metric_records(scores, asdict(params), importance), metrics_path)
    if model_path is not None:
        models.save_model(model, model_path)
    return model
