"""Jobs: quotes to stored bars, bars to modelling dataset."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame

from tickloom.operators import features
from tickloom.operators.events import ofi_bars
from tickloom.operators.prices import bar_returns, price_bars
from tickloom.settings import BAR_LAGS, CHUNK_ROWS, BarSpec, SplitDates
from tickloom.sources.bars import write_bar_partitions, write_combined
from tickloom.sources.quotes import select_quotes

NORMALIZATIONS = ("training_set", "expanding", "daily")


def normalize(bars: DataFrame, normalization: str, dates: SplitDates) -> DataFrame:
    if normalization == "training_set":
        return features.zscore_training(bars, dates.train_end)
    if normalization == "expanding":
        return features.zscore_expanding(bars)
    if normalization == "daily":
        return features.zscore_daily(bars)
    raise ValueError(f"normalization must be one of {', '.join(NORMALIZATIONS)}")


def modelling_dataset(
    bars: DataFrame,
    dates: SplitDates,
    normalization: str = "training_set",
    bar_seconds: int = BarSpec().bar_seconds,
    lags: Iterable[int] = BAR_LAGS,
    dedup: bool = True,
    reset_daily: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Bars with bar time, ``ofi_z``, lags, next-bar target and split label."""
    rows = features.dedup_bars(bars) if dedup else bars
    rows = normalize(features.add_bar_time(rows, bar_seconds), normalization, dates)
    rows = features.add_lags(rows, lags, reset_daily=reset_daily, chunk_rows=chunk_rows)
    return features.add_split(rows, dates)


def bucketed_dataset(
    bars: DataFrame, dates: SplitDates, bar_seconds: int = BarSpec().bar_seconds, lags: Iterable[int] = BAR_LAGS
) -> DataFrame:
    """``modelling_dataset`` of unique bars read from a table bucketed by symbol: nothing is shuffled."""
    rows = features.zscore_training(features.add_bar_time(bars, bar_seconds), dates.train_end)
    return features.add_split(features.add_lags_in_place(rows, lags), dates)


def extract_bars(quotes: DataFrame, path: str, spec: BarSpec = BarSpec()) -> None:
    """Store OFI bars by day."""
    write_bar_partitions(ofi_bars(quotes, spec), path)


def extract_bars_by_month(quotes: DataFrame, path: str, start: date, end: date, spec: BarSpec = BarSpec()) -> None:
    """Store OFI bars month after month, to keep the shuffle of a very long history in bounds.

    No event crosses midnight, so the split changes nothing; each month replaces
    just its own days, so a job that stopped can be run again.
    """
    first = start
    while first <= end:
        following = date(first.year + first.month // 12, first.month % 12 + 1, 1)
        last = min(end, following - timedelta(days=1))
        extract_bars(select_quotes(quotes, start=first, end=last), path, spec)
        first = following


def extract_returns(quotes: DataFrame, path: str, spec: BarSpec = BarSpec()) -> None:
    """Store price bars with returns as one ordered table."""
    write_combined(bar_returns(price_bars(quotes, spec)), path)
