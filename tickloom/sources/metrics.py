"""Metric records as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import nan_to_null

_SCORES = T.StructType(
    [
        T.StructField("mse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("correlation", T.DoubleType()),
        T.StructField("directional_accuracy", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
    ]
)
METRIC_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("feature_importance", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("train", _SCORES),
        T.StructField("validation", _SCORES),
        T.StructField("test", _SCORES),
        T.StructField(
            "history",
            T.StructType(
                [
                    T.StructField("train_loss", T.ArrayType(T.DoubleType())),
                    T.StructField("val_loss", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
    ]
)


def write_metric_records(records: DataFrame, path: str) -> None:
    """One JSON file per record, so that each is a document of its own."""
    records.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def read_metric_records(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """Records of explicit paths, in that order, or of a directory's ``*_metrics.json``.

    ``ord`` keeps the listing order, which decides ties between models.
    """
    reader = spark.read.schema(METRIC_SCHEMA).option("multiLine", True)
    if isinstance(source, str):
        files = f"{source.rstrip('/')}/*_metrics.json"
        return reader.json(files).select("*", F.col("_metadata.file_path").alias("ord"))
    if not source:
        raise FileNotFoundError("no metric files given")
    frames = [reader.json(path).withColumn("ord", F.lit(f"{i:06d}")) for i, path in enumerate(source)]
    records = frames[0]
    for more in frames[1:]:
        records = records.unionByName(more)
    return records


def split_scores(records: DataFrame, split: str = "test") -> DataFrame:
    """Scores of one split as flat columns, NaN as NULL; no model name reads ``unknown``."""
    return records.select(
        F.coalesce("model", F.lit("unknown")).alias("model"),
        "ord",
        *(nan_to_null(F.col(f"{split}.{c}")).alias(c) for c in ("mse", "mae", "correlation", "directional_accuracy")),
        F.coalesce(f"{split}.n_samples", F.lit(0)).alias("n_samples"),
    )
