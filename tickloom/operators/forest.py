"""A fitted forest as data: a table of nodes, and the expression that scores with it.

A node table has ``tree``, ``node`` (heap place: the children of k are 2k + 1 and 2k + 2),
``feature`` (null at a leaf), ``threshold`` (values up to it go left), ``value`` and ``gain``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "tree int, node int, feature string, threshold double, value double, gain double"


def _trees(nodes: Iterable[Mapping]) -> list[dict[int, Mapping]]:
    trees: dict[int, dict[int, Mapping]] = {}
    for row in nodes:
        trees.setdefault(row["tree"], {})[row["node"]] = row
    return [trees[number] for number in sorted(trees)]


def forest_column(nodes: Iterable[Mapping], start: float = 0.0) -> Column:
    """Prediction as a sum of nested conditions, evaluated in the JVM.

    A missing feature gives a missing prediction.
    """

    def at(tree: dict[int, Mapping], place: int) -> Column:
        row = tree[place]
        if row["feature"] is None:
            return F.lit(float(row["value"]))
        below = F.col(row["feature"]) <= F.lit(float(row["threshold"]))
        return F.when(below, at(tree, 2 * place + 1)).when(~below, at(tree, 2 * place + 2))

    total = F.lit(float(start))
    for tree in _trees(nodes):
        total = total + at(tree, 0)
    return total


def forest_sql(nodes: Iterable[Mapping], start: float = 0.0) -> str:
    """The same prediction as SQL text."""

    def number(value: float) -> str:
        return f"CAST({float(value)!r} AS DOUBLE)"

    def at(tree: dict[int, Mapping], place: int) -> str:
        row = tree[place]
        if row["feature"] is None:
            return number(row["value"])
        left, right, cut = at(tree, 2 * place + 1), at(tree, 2 * place + 2), number(row["threshold"])
        return f"CASE WHEN {row['feature']} <= {cut} THEN {left} WHEN {row['feature']} > {cut} THEN {right} END"

    return " + ".join([number(start), *(f"({at(tree, 0)})" for tree in _trees(nodes))])


def importance_shares(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per model ``keys``: ``shares``, a map from feature to the mean gain of its splits, summing to 1."""
    split = nodes.filter(F.col("feature").isNotNull())
    gains = split.groupBy(*keys, "feature").agg(F.avg("gain").alias("gain"))
    entries = F.collect_list(F.struct("feature", "gain"))
    total = F.sum("gain")
    listed = gains.groupBy(*keys).agg(entries.alias("entries"), total.alias("total"))
    shared = F.transform("entries", lambda e: F.struct(e["feature"], e["gain"] / F.col("total")))
    return listed.select(*keys, F.map_from_entries(shared).alias("shares"))


def node_gains(rows: DataFrame, nodes: Iterable[Mapping], target: str, start: float = 0.0) -> DataFrame:
    """How much every split of a forest lowers the squared error of ``rows``: ``tree``, ``node``, ``feature``, ``n``, ``gain``.

    A tree is measured against what the trees before it leave over. Rows that miss a feature of a
    split or the target don't count there; a split that no row reaches is left out.
    """
    trees = _trees(nodes)
    sums, left_over = F.lit(float(start)), {}
    for number, tree in enumerate(trees):
        left_over[f"_over{number}"] = F.col(target) - sums
        sums = sums + forest_column([{**row, "tree": 0} for row in tree.values()])
    entries = []
    for number, tree in enumerate(trees):
        goes_left = {k: F.col(r["feature"]) <= F.lit(float(r["threshold"])) for k, r in tree.items() if r["feature"] is not None}
        for place, row in tree.items():
            if row["feature"] is None:
                continue
            here, met = place, F.lit(True)
            while here:
                above = (here - 1) // 2
                met = met & (goes_left[above] if here % 2 else ~goes_left[above])
                here = above
            entries.append(
                F.struct(
                    F.lit(row["tree"]).alias("tree"), F.lit(place).alias("node"), F.lit(row["feature"]).alias("feature"),
                    F.when(met, goes_left[place]).alias("is_left"), F.col(f"_over{number}").alias("over"),
                )
            )
    reached = rows.withColumns(left_over).select(F.inline(F.array(*entries))).filter("is_left IS NOT NULL AND over IS NOT NULL")
    left, n, nl = F.sum(F.when(F.col("is_left"), F.col("over")).otherwise(0.0)), F.count("over"), F.count_if("is_left")
    right = F.sum(F.when(F.col("is_left"), 0.0).otherwise(F.col("over")))
    sides = reached.groupBy("tree", "node", "feature").agg(n.alias("n"), nl.alias("nl"), left.alias("l"), right.alias("r"))
    worth = [F.coalesce(F.try_divide(F.col(s) * F.col(s), m), F.lit(0.0)) for s, m in (("l", F.col("nl")), ("r", F.col("n") - F.col("nl")))]
    whole = (F.col("l") + F.col("r")) * (F.col("l") + F.col("r")) / F.col("n")
    return sides.select("tree", "node", "feature", "n", (worth[0] + worth[1] - whole).alias("gain"))


def importance_ranking(nodes: DataFrame) -> DataFrame:
    """``feature`` and ``importance`` of a model, largest first."""
    shares = importance_shares(nodes).select(F.explode("shares").alias("feature", "importance"))
    return shares.orderBy(F.desc("importance"), "feature")


def write_forest(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def read_forest(spark: SparkSession, path: str, features: Sequence[str]) -> list[dict]:
    """Nodes of one stored model; a model's size is set by its trees and depth, not by data.

    A feature that isn't listed, or a split without both children, is an error.
    """
    rows = [r.asDict() for r in spark.read.parquet(path).select("tree", "node", "feature", "threshold", "value", "gain").collect()]
    unknown = {r["feature"] for r in rows} - {None, *features}
    if unknown:
        raise ValueError(f"unknown features in the forest: {sorted(unknown)}")
    known = {(r["tree"], r["node"]) for r in rows}
    for r in rows:
        if r["feature"] is not None and not {(r["tree"], 2 * r["node"] + k) for k in (1, 2)} <= known:
            raise ValueError(f"node {r['node']} of tree {r['tree']} lacks a child")
    return rows
