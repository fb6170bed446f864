import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import DAY, OPEN_NS
from tickloom.functions import scalar as fn
from tickloom.operators import prices
from tickloom.settings import BarSpec
from test_events import random_quotes


def q(offset, seq, mid, spread=0.02):
    return (OPEN_NS + offset, seq, mid - spread / 2, 1.0, mid + spread / 2, 1.0)


def test_open_close_and_ties(make_quotes):
    bar = prices.price_bars(make_quotes([q(1, 1, 10), q(2, 2, 12), q(2, 3, 11)])).first()
    assert (bar.bar_open, bar.bar_close, bar.bar_vwap, bar.n_quotes) == pytest.approx((10, 11, 11, 3))


def test_full_bar_averages_distinct_mids_and_times(make_quotes):
    bar = prices.price_bars_full(make_quotes([q(1, 1, 10), q(1, 2, 10), q(2, 3, 13)])).first()
    assert (bar.bar_vwap, bar.n_quotes, bar.bar_low, bar.bar_high) == pytest.approx((11.5, 3, 10, 13))
    assert (bar.bar_open, bar.bar_close) == pytest.approx((10, 13))


def test_quotes_without_two_positive_prices_are_left_out(make_quotes):
    rows = [(OPEN_NS, 1, 0.0, 1.0, 10.0, 1.0), (OPEN_NS, 2, None, 1.0, 10.0, 1.0), (OPEN_NS, 3, 9.0, 1.0, 10.0, 1.0)]
    assert prices.price_bars(make_quotes(rows)).first().n_quotes == 1


@pytest.mark.parametrize("max_rows", [10**9, 25])
def test_ranked_bars_equal_aggregated_bars(make_quotes, max_rows):
    quotes = make_quotes(random_quotes(400, seed=11, span_s=700))
    ranked = prices.price_bars_ranked(quotes, max_rows=max_rows)
    plain = prices.price_bars(quotes)
    rows = [
        {r.bucket: (r.bar_open, r.bar_close, round(r.bar_vwap, 9), round(r.avg_spread, 9), r.n_quotes) for r in b.collect()}
        for b in (ranked, plain)
    ]
    assert rows[0] == rows[1] and rows[0]


def close_bars(spark, days):
    rows = [("AAA", day, i, float(c)) for day, closes in days for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, bucket int, bar_close double")


def test_returns_stay_inside_a_day(spark):
    later = DAY + dt.timedelta(days=1)
    bars = close_bars(spark, [(DAY, [100, 110, 99]), (later, [50, 55]), (later + dt.timedelta(days=1), [7])])
    rows = prices.bar_returns(bars).orderBy("date", "bucket").collect()
    assert [r.bar_return if r.bar_return is None else round(r.bar_return, 9) for r in rows] == [None, 0.1, -0.1, None, 0.1]
    assert rows[1].log_return == pytest.approx(math.log(1.1))
    stats = prices.return_stats(prices.bar_returns(bars)).first()
    assert (stats.n, stats.mean_bps) == (3, pytest.approx(1000 / 3))


def test_bar_width_is_a_parameter(make_quotes):
    quotes = make_quotes([q(0, 1, 10), q(400 * 10**9, 2, 11)])
    assert prices.price_bars(quotes).count() == 2
    assert prices.price_bars(quotes, BarSpec(bar_seconds=1800)).count() == 1


def test_order_key_orders_like_the_pair(spark):
    low, high = -(2**63), 2**63 - 1
    pairs = [(0, None), (0, low), (0, -1), (0, 0), (0, high), (1, None), (1, low), (86_399_999_999_999, high)]
    rows = spark.createDataFrame(list(enumerate(pairs)), "i int, pair struct<time_ns: long, seq: long>").repartition(3)
    key = fn.order_key(F.col("pair.time_ns"), F.col("pair.seq"))
    assert [r.i for r in rows.orderBy(key).collect()] == list(range(len(pairs)))
    assert rows.select(key.alias("k")).distinct().count() == len(pairs)


def test_ties_with_missing_and_negative_sequences(make_quotes):
    rows = [q(1, 5, 10), q(1, -7, 11), q(1, None, 12), q(2, None, 13), q(2, -9, 14)]
    for bars in (prices.price_bars(make_quotes(rows)), prices.price_bars_full(make_quotes(rows))):
        bar = bars.first()
        assert (bar.bar_open, bar.bar_close, bar.n_quotes) == pytest.approx((12, 14, 5))


@pytest.mark.parametrize("build", [prices.price_bars, prices.price_bars_full])
def test_bars_are_hashed_and_not_sorted(make_quotes, build):
    plan = build(make_quotes([q(1, 1, 10)]))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
