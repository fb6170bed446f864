"""Job: how the symbols of each pair move together."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.operators.linear import granger_tests
from tickloom.operators.pairs import contemporaneous_corr, lead_lag_corr, pair_bars
from tickloom.settings import materialize


def pair_analysis(dataset: DataFrame, pairs: DataFrame, path: str, min_rows: int = 100) -> None:
    """Write correlation, lead-lag and causality of every pair as JSON below ``path``.

    The lagged pair table is stored once and aggregated three times.
    """
    wide = materialize(pair_bars(dataset, pairs), "pair-bars")
    results = {
        "correlation": contemporaneous_corr(wide, min_rows),
        "lead_lag": lead_lag_corr(wide, min_rows=min_rows),
        "granger": granger_tests(wide),
    }
    for name, result in results.items():
        result.write.mode("overwrite").json(f"{path}/{name}")
