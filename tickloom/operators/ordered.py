"""Order-dependent operators that stay exact and parallel when one group is huge.

A plain window puts a whole group into one task. The helpers here cut groups
into ordered pieces of limited size and pass the little state that crosses a
cut (a row count, the neighbouring rows) between the pieces:

* ``split_hot_groups``  cuts oversized groups along their order key;
* ``row_positions``     row numbers across such pieces;
* ``over_chunks``       bounded lag / lead / sliding windows over long histories;
* ``cumulative_counts`` rows below a value by prefix sums, hence tie-averaged ranks and exact quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.settings import CHUNK_ROWS, MAX_SLICE_ROWS, materialize

SLICE = "slice"


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key, so grouped values find all their rows."""
    others = [c for c in right.columns if c not in keys]
    renamed = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *others)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(renamed, same).drop(*(f"_right_{k}" for k in keys))


def split_hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int = MAX_SLICE_ROWS,
    reused: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Cut oversized groups along their order; return the rows and the piece keys.

    One key-only count decides. Usually nothing is hot, and rows and keys come
    back as they were. Otherwise the keys gain an ordered ``slice`` number: rows
    of hot groups are range-partitioned on (keys, order), which may cut inside
    a single instant because the order ends in a unique column, and the
    partition number is the slice. ``reused`` must be set when the result feeds
    more than one branch of a plan: range bounds are sampled per branch, so the
    hot rows are then written out once.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in_group")).filter(F.col("rows_in_group") > max_rows)
    hot_total = hot.agg(F.sum("rows_in_group")).first()[0]
    if hot_total is None:
        return df, list(keys)
    # At most total_rows / max_rows keys, whatever the data: safe to broadcast.
    hot_keys = F.broadcast(materialize(hot.select(*keys), "hot-keys"))
    cold = df.join(hot_keys, list(keys), "left_anti").withColumn(SLICE, F.lit(0))
    pieces = math.ceil(2 * hot_total / max_rows)
    sliced = (
        df.join(hot_keys, list(keys), "left_semi")
        .repartitionByRange(pieces, *keys, *order)
        .withColumn(SLICE, F.spark_partition_id())
    )
    if reused:
        sliced = materialize(sliced, "hot-slices")
    return cold.unionByName(sliced), [*keys, SLICE]


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int = MAX_SLICE_ROWS,
) -> DataFrame:
    """Add ``from_start`` / ``from_end``: row numbers from either end of each group.

    Keys must not be NULL; the join then keeps the window's partitioning.
    """
    sliced, piece = split_hot_groups(df, keys, order, max_rows, reused=True)
    if piece == list(keys):
        group = Window.partitionBy(*keys)
        first = F.row_number().over(group.orderBy(*order))
        return sliced.withColumns({"from_start": first, "from_end": F.count(F.lit(1)).over(group) - first + 1})
    counts = sliced.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *piece,
        F.coalesce(F.sum("_n").over(whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )
    numbered = sliced.withColumn("_rn", F.row_number().over(Window.partitionBy(*piece).orderBy(*order)))
    return (
        numbered.join(offsets, piece)
        .withColumn("from_start", F.col("_before") + F.col("_rn"))
        .withColumn("from_end", F.col("_total") - F.col("from_start") + 1)
        .drop(SLICE, "_rn", "_before", "_total")
    )


def history_positions(
    df: DataFrame,
    keys: Sequence[str],
    day: str = "date",
    order: Sequence[str] = ("bucket",),
) -> DataFrame:
    """Add ``pos``, the 0-based place of a bar in its keys' whole history.

    Bars are unique per (keys, day, bucket), so a day holds at most
    86400 / bar_seconds of them and the per-day window is bounded. Only one
    count per day goes through the per-key window. The counts read ``df`` a
    second time (its keys only): hand in a stored frame, not a long pipeline.
    """
    # A missing day counts as one day before all others, and stays joinable.
    dated = df.withColumn("_day", F.coalesce(F.col(day), F.lit("0001-01-01").cast("date")))
    days = dated.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(*order))
    return (
        join_on_keys(dated.withColumn("_rn", within), days, [*keys, "_day"])
        .withColumn("pos", F.col("_before") + F.col("_rn") - 1)
        .drop("_day", "_rn", "_before")
    )


def over_chunks(
    positioned: DataFrame,
    keys: Sequence[str],
    behind: int,
    ahead: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Evaluate window columns that look at most ``behind`` / ``ahead`` rows away.

    History is cut into chunks of ``chunk_rows`` positions; the few rows next to
    a cut are copied into the neighbouring chunk as context and dropped again.
    """
    chunk_rows = max(chunk_rows, behind, ahead, 1)
    chunk = F.floor(F.col("pos") / F.lit(chunk_rows))
    place = F.col("pos") % F.lit(chunk_rows)
    copies = F.array_compact(
        F.array(
            chunk,
            F.when(place >= chunk_rows - behind, chunk + 1),
            F.when((place < ahead) & (chunk > 0), chunk - 1),
        )
    )
    spread_out = positioned.withColumn("_home", chunk).withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy(*keys, "_chunk").orderBy("pos")
    return (
        spread_out.withColumns(dict(build(window)))
        .filter(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )


def shift_columns(
    df: DataFrame,
    keys: Sequence[str],
    shifts: Mapping[str, tuple[str, int]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``name -> (column, k)``: the value k rows earlier (k < 0: later) per key."""
    offsets = [k for _, k in shifts.values()]

    def build(window: WindowSpec) -> dict[str, Column]:
        return {
            name: (F.lag(column, k) if k >= 0 else F.lead(column, -k)).over(window)
            for name, (column, k) in shifts.items()
        }

    positioned = history_positions(df, keys)
    shifted = over_chunks(positioned, keys, max(0, *offsets), max(0, *(-k for k in offsets)), build, chunk_rows)
    return shifted.drop("pos")


def cumulative_counts(df: DataFrame, group: Sequence[str], value: str, pieces: int | None = None) -> DataFrame:
    """Distinct values per group with ``n`` (copies), ``before`` (rows below) and ``total``.

    Copies of a value are counted before anything is ordered, so a hot value is
    one row. The distinct values are then range-partitioned on (group, value),
    which cuts any single large group, and stored; a partition starts from the
    sum of the partitions before it, one row per group and partition.
    ``pieces`` is the number of partitions, the session's by default.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return running_counts(values, group, value, pieces)


def running_counts(values: DataFrame, group: Sequence[str], value: str, pieces: int | None = None) -> DataFrame:
    """``cumulative_counts`` of values that come with their number ``n`` of copies."""
    group = list(group)
    ranged = values.repartitionByRange(*([] if pieces is None else [pieces]), *group, value)
    # Stored, because range bounds are drawn anew wherever a plan is repeated.
    placed = materialize(ranged.withColumn("_piece", F.spark_partition_id()), "ranged-values")
    piece, whole = [*group, "_piece"], Window.partitionBy(*group)
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*piece).agg(F.sum("n").alias("_n"))
    offsets = offsets.select(
        *piece, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_below"), F.sum("_n").over(whole).alias("total")
    )
    running = Window.partitionBy(*piece).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum("n").over(running), F.lit(0)))
    before = F.col("_below") + F.col("_inside")
    return join_on_keys(inside, offsets, piece).select(*group, value, "n", before.alias("before"), "total")


def _average_rank() -> Column:
    return F.col("before") + (F.col("n") + 1) / 2.0


def average_ranks(df: DataFrame, group: Sequence[str], value: str, pieces: int | None = None) -> DataFrame:
    """One row per (group, value) with its 1-based rank, averaged over ties."""
    counted = cumulative_counts(df, group, value, pieces)
    return counted.select(*group, value, _average_rank().alias("avg_rank"), "n")


def centred_ranks(values: DataFrame, group: Sequence[str], value: str, pieces: int | None = None) -> DataFrame:
    """Average ranks of values with their number ``n``, less the mean rank of the group."""
    counted = running_counts(values, group, value, pieces)
    return counted.select(*group, value, (_average_rank() - (F.col("total") + 1) / 2.0).alias("rank"))


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    pieces: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, named by ``probabilities``.

    The built-in ``percentile`` keeps every distinct value of a group in one
    task's memory; here only the one or two values at each rank are picked.
    """
    return quantiles_of(cumulative_counts(df, group, value, pieces), group, value, probabilities)


def quantiles_of(counted: DataFrame, group: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Quantiles from the rows of ``cumulative_counts``."""

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(value)))

    picks, results = [], []
    for name, p in probabilities.items():
        rank = (F.col("total") - 1) * F.lit(p)
        picks += [
            at(F.floor(rank)).alias(f"_{name}_lo"),
            at(F.ceil(rank)).alias(f"_{name}_hi"),
            F.max(rank - F.floor(rank)).alias(f"_{name}_part"),
        ]
        low, high, part = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "part"))
        results.append((low + (high - low) * part).alias(name))
    return counted.groupBy(*group).agg(*picks).select(*group, *results)
