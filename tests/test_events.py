import random

from pyspark.sql import functions as F

from conftest import DAY, OPEN_NS, rows_of
from tickloom.operators.events import ofi_bars, ofi_events
from tickloom.settings import BarSpec

GOLDEN = [
    (OPEN_NS + 1, 1, 10.00, 5.0, 10.02, 4.0),
    (OPEN_NS + 2, 2, 10.01, 7.0, 10.02, 6.0),
    (OPEN_NS + 3, 3, 10.01, 3.0, 10.03, 2.0),
    (OPEN_NS + 4, 4, 10.00, 9.0, 10.01, 8.0),
]


def brute_force(rows, bar_seconds=300):
    """Bars of one symbol-day by a plain loop over ordered quotes."""
    bars, previous = {}, None
    for t, _, bid, bs, ask, as_ in sorted(rows):
        if previous is not None and previous[0] is not None and previous[2] is not None:
            pb, pbs, pa, pas = previous
            if bid is not None and bid > pb:
                e_bid = bs
            elif bid is not None and bid < pb:
                e_bid = -pbs
            else:
                e_bid = bs - pbs
            if ask is not None and ask < pa:
                e_ask = -as_
            elif ask is not None and ask > pa:
                e_ask = pas
            else:
                e_ask = pas - as_
            bar = bars.setdefault(t // (bar_seconds * 10**9), [0.0, 0, t, t])
            bar[0] += e_bid + e_ask
            bar[1] += 1
            bar[2], bar[3] = min(bar[2], t), max(bar[3], t)
        previous = (bid, bs, ask, as_)
    return {k: tuple(v) for k, v in bars.items()}


def collected(bars):
    return {r.bucket: (r.ofi, r.n_events, r.bar_start, r.bar_end) for r in bars.collect()}


def random_quotes(n, seed, span_s=3000, ties=True):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        t = OPEN_NS + rng.randrange(span_s) * 10**9 + (0 if ties else rng.randrange(10**9))
        bid = rng.choice([None, 0.0, 10.0, 10.01, 10.02])
        ask = rng.choice([None, 10.03, 10.04, 10.05])
        rows.append((t, seq, bid, float(rng.randrange(1, 9)), ask, float(rng.randrange(1, 9))))
    return rows


def test_golden_terms(make_quotes):
    rows = ofi_events(make_quotes(GOLDEN)).orderBy("seq").collect()
    assert [(r.e_bid, r.e_ask) for r in rows] == [(7, -2), (-4, 6), (-3, -8)]
    assert collected(ofi_bars(make_quotes(GOLDEN)))[114][:2] == (-4.0, 3)


def test_null_ask_takes_the_unchanged_branch(make_quotes):
    rows = [*GOLDEN[:2], (*GOLDEN[2][:4], None, 2.0), GOLDEN[3]]
    assert collected(ofi_bars(make_quotes(rows)))[114][:2] == (5.0, 2)


def test_null_size_counts_but_does_not_sum(make_quotes):
    rows = [GOLDEN[0], (OPEN_NS + 2, 2, 10.00, None, 10.02, 6.0)]
    assert collected(ofi_bars(make_quotes(rows)))[114][:2] == (None, 1)


def test_session_edges(make_quotes):
    edges = [(OPEN_NS - 1, 114), (OPEN_NS, 114), (16 * 3600 * 10**9 - 1, 191), (16 * 3600 * 10**9, 192)]
    rows = [(t, i, 10.0 + i, 1.0, 11.0 + i, 1.0) for i, (t, _) in enumerate(edges)]
    events = ofi_events(make_quotes(rows)).collect()
    # The quote at the open has no predecessor inside the session.
    assert [(e.seq, e.bucket) for e in events] == [(2, 191)]


def test_bars_match_brute_force_whatever_the_slicing(make_quotes):
    rows = random_quotes(600, seed=1)
    expected = brute_force(rows)
    quotes = make_quotes(rows)
    for slot_seconds in (300, 40, 3, 0.25):
        assert collected(ofi_bars(quotes, slot_seconds=slot_seconds)) == expected
        events = ofi_events(quotes, slot_seconds=slot_seconds)
        sums = events.groupBy("bucket").agg(F.sum(F.col("e_bid") + F.col("e_ask")).alias("s"), F.count("*").alias("n"))
        assert {r.bucket: (r.s or 0.0, r.n) for r in sums.collect()} == {k: (v[0], v[1]) for k, v in expected.items()}


def test_one_second_holding_everything_is_cut_too(make_quotes):
    rows = random_quotes(300, seed=2, span_s=1)
    assert collected(ofi_bars(make_quotes(rows), slot_seconds=0.01)) == brute_force(rows)


def test_hot_symbol_next_to_cold_ones(make_quotes):
    hot, cold = random_quotes(400, seed=3, span_s=900), random_quotes(30, seed=4)
    both = make_quotes(hot).unionByName(make_quotes(cold, "BBB"))
    bars = ofi_bars(both, slot_seconds=20)
    assert collected(bars.filter("symbol = 'AAA'")) == brute_force(hot)
    assert collected(bars.filter("symbol = 'BBB'")) == brute_force(cold)


def test_result_does_not_depend_on_partitioning(make_quotes):
    quotes = make_quotes(random_quotes(200, seed=5))
    one, many = ofi_bars(quotes.coalesce(1)), ofi_bars(quotes.repartition(7))
    assert rows_of(one) == rows_of(many)


def test_other_bar_width(make_quotes):
    rows = random_quotes(200, seed=6)
    assert collected(ofi_bars(make_quotes(rows), BarSpec(bar_seconds=1800))) == brute_force(rows, 1800)


def test_days_are_independent(make_quotes):
    import datetime as dt

    rows = random_quotes(60, seed=7)
    two = make_quotes(rows).unionByName(make_quotes(rows, day=DAY + dt.timedelta(days=1)))
    per_day = [collected(ofi_bars(two).filter(F.col("date") == F.lit(DAY + dt.timedelta(days=i)))) for i in (0, 1)]
    assert per_day[0] == per_day[1] == brute_force(rows)


def test_quotes_move_once(make_quotes):
    """One exchange of quotes, keyed finer than a symbol-day, and no unpartitioned window."""
    bars = ofi_bars(make_quotes(GOLDEN))
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning") == 2
    assert "hashpartitioning(symbol" in plan and "bucket" in plan.split("Exchange hashpartitioning")[2]


def test_events_scan_and_move_quotes_once(spark, make_quotes, tmp_path):
    make_quotes(random_quotes(200, seed=8)).write.parquet(str(tmp_path / "quotes"))
    events = ofi_events(spark.read.parquet(str(tmp_path / "quotes")))
    events.collect()
    final = events._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_no_job_runs_while_the_plan_is_built(spark, make_quotes):
    quotes = make_quotes(random_quotes(50, seed=9))
    spark.sparkContext.setJobGroup("building", "building")
    ofi_bars(quotes), ofi_events(quotes)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
