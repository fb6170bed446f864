"""The four experiment suites: which features predict which target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tickloom.operators.models import Experiment, TreeParams, run_experiments
from tickloom.operators.pairs import PAIR_KEYS
from tickloom.settings import FEATURES, PAIR_LAGS, TARGET

# Feature sets of the suites.
ABLATIONS = {
    "full_model": FEATURES,
    "no_current_ofi": FEATURES[1:],
    "only_current_ofi": ("ofi_z",),
    "only_lag1": ("lag1",),
    "lags_1_2_3": ("lag1", "lag2", "lag3"),
}
CHANGE_FEATURES = ("ofi_z_change", "ofi_change_lag1", "ofi_change_lag2", "ofi_change_lag3")
CHANGE_SETS = {
    "ofi_only": FEATURES,
    "ofi_change_only": CHANGE_FEATURES,
    "all_features": FEATURES + CHANGE_FEATURES,
}
MIN_PAIR_TRAIN_ROWS = 100


def ablation_suite(dataset: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    return run_experiments(dataset, [Experiment(n, tuple(f), TARGET) for n, f in ABLATIONS.items()], 1, params)


def change_suite(changes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """OFI against OFI-change features; ``changes`` is the frame of ``add_ofi_changes``."""
    return run_experiments(changes, [Experiment(n, f, "next_ofi_z") for n, f in CHANGE_SETS.items()], 1, params)


def cross_experiments() -> list[Experiment]:
    """Each side from the other, from itself, and from both."""
    found = []
    for effect, cause in (("b", "a"), ("a", "b")):
        found += [
            Experiment(f"{cause}_to_{effect}", (f"{cause}_ofi_z", *(f"{cause}_lag{k}" for k in (1, 2, 3))), f"{effect}_next"),
            Experiment(f"{effect}_own", (f"{effect}_ofi_z", *(f"{effect}_lag{k}" for k in (1, 2, 3))), f"{effect}_next"),
            Experiment(
                f"{effect}_from_both",
                tuple(f"{side}_{c}" for side in (effect, cause) for c in ("ofi_z", "lag1", "lag2")),
                f"{effect}_next",
            ),
        ]
    return found


def cross_suite(pair_bars: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """Every pair of the frame, all fits in the same jobs."""
    return run_experiments(pair_bars, cross_experiments(), MIN_PAIR_TRAIN_ROWS, params, by=PAIR_KEYS)


def price_experiments(lags: Sequence[int] = PAIR_LAGS) -> list[Experiment]:
    """Past returns, order flow, or both, of one or both sides, for each side's next return."""
    found = []
    for own, other in (("b", "a"), ("a", "b")):
        price = {s: tuple(f"{s}_ret_lag{k}" for k in lags) for s in "ab"}
        flow = {s: (f"{s}_ofi_z", *(f"{s}_ofi_lag{k}" for k in (1, 2, 3))) for s in "ab"}
        sets = {
            "price_only_own": price[own],
            "price_only_both": price[own] + price[other],
            "ofi_only_own": flow[own],
            "ofi_only_both": flow[own] + flow[other],
            "price_plus_ofi_own": price[own] + flow[own],
            "price_plus_ofi_both": price[own] + price[other] + flow[own] + flow[other],
        }
        found += [Experiment(f"{own}:{name}", f, f"{own}_ret_next") for name, f in sets.items()]
    return found


def price_vs_ofi_suite(pair_returns: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """Every pair of the frame; adds the rank information coefficient to the metrics."""
    return run_experiments(
        pair_returns, price_experiments(), MIN_PAIR_TRAIN_ROWS, params, with_rank_ic=True, by=PAIR_KEYS
    )
