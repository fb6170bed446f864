"""Jobs: a suite's result and a comparison of models, each as one JSON document.

Parameters and experiments are free-form, so documents are read back as VARIANT.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.evaluation import METRICS, best_models
from tickloom.sources.metrics import split_scores

SCORES = {**dict.fromkeys(METRICS, "double"), "information_coefficient": "double", "n_samples": "long"}


def _write_document(document: DataFrame, path: str) -> None:
    """One row as one JSON file; missing values are kept as null."""
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_suite(
    result: DataFrame, path: str, description: str, params: Mapping[str, object] | None = None, by: Sequence[str] = ()
) -> None:
    """``timestamp``, ``description``, ``params`` of any shape, and ``experiments`` by name.

    With ``by`` the experiments of a group stand below the group's keys joined by ``|``. A suite has a
    row per group and experiment, so its result is small.
    """
    entry = F.struct(*(c for c in result.columns if c not in ("experiment", *by)))
    named = F.map_from_entries(F.sort_array(F.collect_list(F.struct("experiment", F.to_json(entry, {"ignoreNullFields": "false"})))))
    groups = result.groupBy(*by).agg(named.alias("entries"))
    if by:
        keyed = F.collect_list(F.struct(F.concat_ws("|", *by), "entries"))
        groups = groups.agg(F.map_from_entries(keyed).alias("entries"))
    parsed = _parsed(F.col("entries"), len(by) > 0)
    _write_document(
        groups.select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.lit(description).alias("description"),
            F.parse_json(F.lit(json.dumps(dict(params or {})))).alias("params"),
            parsed.alias("experiments"),
        ),
        path,
    )


def _parsed(entries: Column, nested: bool) -> Column:
    if nested:
        return F.transform_values(entries, lambda _, inner: _parsed(inner, False))
    return F.transform_values(entries, lambda _, text: F.parse_json(text))


def write_comparison(records: DataFrame, path: str) -> None:
    """Metric records in their order as ``models``, and the winner of every metric as ``comparison``."""
    text = F.to_json(F.struct(*(c for c in records.columns if c != "ord")))
    ordered = F.sort_array(F.collect_list(F.struct("ord", text.alias("text"))))
    models = records.agg(F.transform(ordered, lambda r: F.parse_json(r["text"])).alias("models"))
    winners = best_models(split_scores(records)).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("best", "value")))).alias("comparison")
    )
    # Two rows, one of each.
    both = models.withColumn("_one", F.lit(1)).join(winners.withColumn("_one", F.lit(1)), "_one").drop("_one")
    _write_document(both, path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents as the VARIANT column ``document``, one row per file."""
    return spark.read.option("singleVariantColumn", "document").option("multiLine", True).json(path)


_ENTRIES = "SELECT document, entry.key AS name, entry.value AS entry FROM {documents}, LATERAL variant_explode(variant_get(document, '{field}', 'variant')) AS entry"


def _entries(documents: DataFrame, field: str) -> DataFrame:
    return documents.sparkSession.sql(_ENTRIES.replace("{field}", field), documents=documents)


def suite_rows(documents: DataFrame, params: Mapping[str, str] | None = None, grouped: bool = False) -> DataFrame:
    """One row per experiment of suite documents: names, ``n_test``, ``features``, the scores that are there, ``importance``.

    ``params`` names fields below ``params`` (a path such as ``session.open`` or ``lags[1]``) and their
    types; a field that is absent or doesn't convert is NULL.
    """
    rows = _entries(documents, "$.experiments")
    if grouped:
        groups = rows.withColumnRenamed("name", "group_name").withColumnRenamed("entry", "inner")
        rows = groups.sparkSession.sql(
            "SELECT document, group_name, entry.key AS name, entry.value AS entry FROM {groups}, LATERAL variant_explode(inner) AS entry", groups=groups
        )

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("entry", f"$.{path}", kind)

    return rows.select(
        *(["group_name"] if grouped else []),
        F.col("name").alias("experiment"),
        F.try_variant_get("document", "$.description", "string").alias("description"),
        field("target", "string").alias("target"),
        field("features", "array<string>").alias("features"),
        field("n_test", "long").alias("n_test"),
        *(field(f"metrics.{name}", kind).alias(name) for name, kind in SCORES.items()),
        field("importance", "map<string,double>").alias("importance"),
        *(F.try_variant_get("document", f"$.params.{path}", kind).alias(path.replace(".", "_").replace("[", "_").rstrip("]")) for path, kind in (params or {}).items()),
    )


def comparison_rows(documents: DataFrame) -> DataFrame:
    """``metric``, ``best`` and ``value`` of comparison documents."""
    return _entries(documents, "$.comparison").select(
        F.col("name").alias("metric"),
        F.try_variant_get("entry", "$.best", "string").alias("best"),
        F.try_variant_get("entry", "$.value", "double").alias("value"),
    )
