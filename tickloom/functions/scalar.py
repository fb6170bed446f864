"""Column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.settings import BAR_SECONDS, NS_PER_SECOND, SessionHours, SplitDates

# How a month and a day may be written.
MONTH = "(1[0-2]|0[1-9]|[1-9])"
DAY = "(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def time_bucket(time_ns: Column, bar_seconds: int = BAR_SECONDS) -> Column:
    """Index of the bar holding a time of day; bar 0 starts at midnight."""
    return F.floor(time_ns / F.lit(bar_seconds * NS_PER_SECOND)).cast("int")


def order_key(time_ns: Column, seq: Column) -> Column:
    """(time, sequence) as one number of fixed width, in the order of the pair; a missing sequence comes first.

    Aggregates ordered by it have buffers that can be updated in place, so Spark hashes instead of sorting.
    """
    shifted = F.coalesce(seq.cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1)), F.lit(Decimal(0)))
    return time_ns.cast("decimal(17,0)") * F.lit(Decimal(10**20)) + shifted


def in_session(time_ns: Column, session: SessionHours = SessionHours()) -> Column:
    start, end = session.open_s * NS_PER_SECOND, session.close_s * NS_PER_SECOND
    return (time_ns >= start) & (time_ns < end)


def clean_symbols(symbols: Iterable[str]) -> list[str]:
    return [s.strip().upper() for s in symbols if s.strip()]


def symbol_in(symbol: Column, symbols: Iterable[str]) -> Column:
    """Case- and blank-insensitive membership in a symbol list."""
    return F.upper(F.trim(symbol)).isin(clean_symbols(symbols))


def positive_quote(bid: Column, ask: Column) -> Column:
    return (bid > 0) & (ask > 0)


def mid_quote(bid: Column, ask: Column) -> Column:
    return (bid + ask) / F.lit(2.0)


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def bid_event(bid: Column, size: Column, prev_bid: Column, prev_size: Column) -> Column:
    """Order flow added at the bid. A NULL comparison counts as "price unchanged"."""
    return (
        F.when(bid > prev_bid, size)
        .when(bid < prev_bid, -prev_size)
        .otherwise(size - prev_size)
    )


def ask_event(ask: Column, size: Column, prev_ask: Column, prev_size: Column) -> Column:
    """Order flow added at the ask, already signed so that it is summed with the bid's."""
    return (
        F.when(ask < prev_ask, -size)
        .when(ask > prev_ask, prev_size)
        .otherwise(prev_size - size)
    )


def bar_datetime(day: Column, bucket: Column, bar_seconds: int = BAR_SECONDS) -> Column:
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (bucket * bar_seconds).cast("decimal(18,6)"))
    return day.cast("timestamp_ntz") + offset


def bar_clock(day: Column, bucket: Column, bar_seconds: int = BAR_SECONDS) -> Column:
    return F.date_format(bar_datetime(day, bucket, bar_seconds), "HH:mm")


def try_parse_date(text: Column) -> Column:
    """Year, month and day with dashes or packed; NULL when neither fits.

    Month and day may be of one digit. A packed text gives the month as many digits as leave a day.
    """

    def numbers(separator: str) -> Column:
        pattern = f"^([0-9]{{4}}){separator}{MONTH}{separator}{DAY}$"
        parts = [F.lpad(F.trim(F.regexp_extract(text, pattern, k)), width, "0") for k, width in ((1, 4), (2, 2), (3, 2))]
        known = text.rlike(pattern) & ~text.startswith("0000")
        return F.when(known, F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))

    return F.coalesce(numbers("-"), numbers(""))


def parse_date(text: Column) -> Column:
    """Like :func:`try_parse_date`, but a text in neither form fails the query."""
    failed = F.raise_error(F.concat(F.lit("cannot parse date: "), text)).cast("date")
    parsed = try_parse_date(text)
    return F.when(text.isNull(), F.lit(None).cast("date")).when(parsed.isNotNull(), parsed).otherwise(failed)


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def split_label(day: Column, dates: SplitDates) -> Column:
    return (
        F.when(day <= F.lit(dates.train_end), "train")
        .when(day.between(F.lit(dates.val_start), F.lit(dates.val_end)), "val")
        .when(day >= F.lit(dates.test_start), "test")
        .otherwise("unknown")
    )


def basis_points(value: Column) -> Column:
    return value * F.lit(10000.0)


def standardize(value: Column, mean: Column, deviation: Column) -> Column:
    """z-score; 0 where the deviation is missing or zero."""
    flat = deviation.isNull() | (deviation == 0)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(value - mean, deviation))


def fixed_decimals(value: Column, digits: int) -> Column:
    return F.when(value.isNull(), F.lit("nan")).otherwise(F.format_string(f"%.{digits}f", value))


def percent_text(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("nan%")).otherwise(F.format_string("%.2f%%", value * 100))
