"""Symbols side by side: pair joins, correlation and lead-lag analysis.

Pairs always come as an explicit (symbol_a, symbol_b) table. Deriving all pairs
from the data would grow with the square of the number of symbols.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.stats import pair_count, safe_corr
from tickloom.operators.ordered import shift_columns
from tickloom.settings import ACF_LAGS, CHUNK_ROWS, PAIR_LAGS, materialize

PAIR_KEYS = ["symbol_a", "symbol_b"]


def pair_table(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(dict.fromkeys(pairs)), "symbol_a string, symbol_b string")


def pair_join(bars: DataFrame, pairs: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Inner equi-join of two symbols' bars on (date, bucket), one row per pair and bar.

    ``columns`` maps bar columns to the names they get behind ``a_`` and ``b_``.
    Only symbols some pair names are shuffled. The list of pairs has no hint: adaptive execution
    broadcasts one it has measured to be small, and splits a symbol with many partners otherwise. A ``split`` column is taken from side a.
    """
    pairs = pairs.select(*PAIR_KEYS).distinct()
    shared = ["split"] if "split" in bars.columns else []
    side_a = bars.select(
        F.col("symbol").alias("symbol_a"), "date", "bucket", *shared, *(F.col(c).alias(f"a_{n}") for c, n in columns.items())
    )
    side_b = bars.select(
        F.col("symbol").alias("symbol_b"), "date", "bucket", *(F.col(c).alias(f"b_{n}") for c, n in columns.items())
    ).join(pairs.select("symbol_b").distinct(), "symbol_b", "left_semi")
    joined = side_a.join(pairs, "symbol_a").join(side_b, ["symbol_b", "date", "bucket"])
    return joined.select(*PAIR_KEYS, "date", "bucket", *shared, *(f"{s}_{n}" for s in "ab" for n in columns.values()))


def pair_shifts(
    wide: DataFrame,
    lagged: Mapping[str, str],
    targets: Mapping[str, str],
    lags: Iterable[int] = PAIR_LAGS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Lags and next-bar values of both sides along a pair's matched bars.

    Positions need a day count besides the rows, so the join is stored first
    and done once. ``lagged`` and ``targets`` map column stems (without side) to output stems.
    """
    shifts: dict[str, tuple[str, int]] = {}
    for side in ("a", "b"):
        for stem, out in lagged.items():
            shifts.update({f"{side}_{out}{k}": (f"{side}_{stem}", k) for k in lags})
        shifts.update({f"{side}_{out}": (f"{side}_{stem}", -1) for stem, out in targets.items()})
    return shift_columns(materialize(wide, "pairs"), PAIR_KEYS, shifts, chunk_rows)


def pair_bars(dataset: DataFrame, pairs: DataFrame, lags: Sequence[int] = PAIR_LAGS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """OFI pair table with ``a_lag{k}``, ``b_lag{k}``, ``a_next`` and ``b_next``."""
    wide = pair_join(dataset, pairs, {"ofi": "ofi", "ofi_z": "ofi_z"})
    return pair_shifts(wide, {"ofi_z": "lag"}, {"ofi_z": "next"}, lags, chunk_rows)


def pair_returns(
    dataset: DataFrame,
    returns: DataFrame,
    pairs: DataFrame,
    lags: Sequence[int] = PAIR_LAGS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """OFI and returns of both symbols, all four present, with lags and next returns."""
    priced = dataset.join(
        returns.select("symbol", "date", "bucket", "bar_return", "avg_spread"), ["symbol", "date", "bucket"]
    )
    wide = pair_join(priced, pairs, {"ofi": "ofi", "ofi_z": "ofi_z", "bar_return": "ret", "avg_spread": "spread"})
    return pair_shifts(wide, {"ret": "ret_lag", "ofi_z": "ofi_lag"}, {"ret": "ret_next"}, lags, chunk_rows)


def contemporaneous_corr(pairs_wide: DataFrame, min_rows: int = 100) -> DataFrame:
    """Correlation of the two sides per pair, where more than ``min_rows`` rows match."""
    a, b = F.col("a_ofi_z"), F.col("b_ofi_z")
    return (
        pairs_wide.groupBy(*PAIR_KEYS)
        .agg(pair_count(a, b).alias("n"), safe_corr(a, b).alias("correlation"))
        .filter(F.col("n") > min_rows)
    )


def lead_lag_corr(pairs_lagged: DataFrame, lags: Sequence[int] = PAIR_LAGS, min_rows: int = 100) -> DataFrame:
    """Correlation of each side's lag with the other side, both directions.

    All lags are aggregated in one pass and only the result is unfolded.
    """
    cells = []
    for direction, leader, follower in (("a_leads_b", "a", "b"), ("b_leads_a", "b", "a")):
        for k in lags:
            x, y = F.col(f"{leader}_lag{k}"), F.col(f"{follower}_ofi_z")
            cells.append((direction, k, pair_count(x, y), safe_corr(x, y)))
    return _unfold(pairs_lagged, PAIR_KEYS, cells, ("direction", "lag")).filter(F.col("n") > min_rows)


def autocorrelation(
    dataset: DataFrame,
    lags: Sequence[int] = ACF_LAGS,
    min_rows: int = 100,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Correlation of ``ofi_z`` with its own past per symbol, missing values left out first."""
    values = dataset.filter(F.col("ofi_z").isNotNull()).select("symbol", "date", "bucket", "ofi_z")
    shifted = shift_columns(values, ["symbol"], {f"lag{k}": ("ofi_z", k) for k in lags}, chunk_rows)
    cells = [(k, pair_count(F.col("ofi_z"), F.col(f"lag{k}")), safe_corr(F.col("ofi_z"), F.col(f"lag{k}"))) for k in lags]
    unfolded = _unfold(shifted, ["symbol"], cells, ("lag",), F.count(F.lit(1)))
    # A lag as long as the series has no pairs at all and gives no row.
    return unfolded.filter((F.col("rows") >= min_rows) & (F.col("n") > 0)).drop("rows")


def _unfold(df: DataFrame, keys: Sequence[str], cells, labels: Sequence[str], rows=None) -> DataFrame:
    """Aggregate every (labels..., n, correlation) cell per key and give one row per cell."""
    structs = [
        F.struct(
            *(F.lit(value).alias(label) for label, value in zip(labels, cell)),
            cell[-2].alias("n"),
            cell[-1].alias("correlation"),
        )
        for cell in cells
    ]
    extra = [] if rows is None else [rows.alias("rows")]
    cube = df.groupBy(*keys).agg(F.array(*structs).alias("cells"), *extra)
    return cube.select(*keys, *(["rows"] if extra else []), F.inline("cells"))
