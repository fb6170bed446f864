"""Helpers on DataFrames shared by the operators."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.settings import materialize


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, for intermediate columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_bitmaps(ids: DataFrame, id_col: str) -> DataFrame:
    """Set of ids as one 4 KB bitmap per range of 32,768 ids: columns ``bucket``, ``bits``.

    A bit per possible id makes a set small enough that Spark can mostly join it without moving
    the other side. It is stored, so that Spark knows its size before it plans that join.
    """
    known = ids.filter(F.col(id_col).isNotNull())
    bitmaps = known.groupBy(F.bitmap_bucket_number(id_col).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias("bits")
    )
    return materialize(bitmaps, "bitmaps")


def with_membership(df: DataFrame, id_col: str, bitmaps: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: whether the id is in the set; false for a null id."""
    bucket, bits = unused(df, "id_bucket"), unused(df, "id_bits")
    joined = df.withColumn(bucket, F.bitmap_bucket_number(id_col)).join(
        bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)), bucket, "left"
    )
    position = F.bitmap_bit_position(id_col)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.when(F.col(bits).isNotNull(), F.call_function("getbit", byte, (position % 8).cast("int")) == 1)
    return joined.select(*df.columns, F.coalesce(bit, F.lit(False)).alias(name))


def _roots(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` of every ``b``: its smallest neighbour's, followed to the end."""
    tree = materialize(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "hooked")
    while True:
        upper = tree.select(F.col("id").alias("root"), F.col("root").alias("above"))
        joined = tree.join(upper, "root", "left")
        jumped = materialize(
            joined.select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jumped"
        )
        tree = jumped.select("id", "root")
        if not jumped.filter("moved").take(1):
            return tree


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links (long columns ``a``, ``b``).

    Returns ``id`` and ``component``, the smallest id reachable, for every id that isn't the
    smallest of its own component. Loops, repeats and either direction are fine.

    A round hooks every id under its smallest neighbour, follows the trees to their roots by
    doubling, and keeps the links between roots for the next one. All of it is joins and
    aggregates with partial sums over tables in the shared folder.
    """
    ends = links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(ends.distinct(), "edges")
    labels = edges.select(F.col("b").alias("id"), F.col("a").alias("component")).limit(0)
    while edges.take(1):
        roots = _roots(edges)
        above = roots.select(F.col("id").alias("component"), F.col("root"))
        moved = labels.join(above, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        labels = materialize(moved.unionByName(roots.withColumnRenamed("root", "component")), "components")
        low, high = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        joined = edges.join(low, "a", "left").join(high, "b").withColumn("root_a", F.coalesce("root_a", "a"))
        edges = materialize(
            joined.filter("root_a != root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
            .distinct(),
            "edges",
        )
    return labels


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path or URI that all executors reach, and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
