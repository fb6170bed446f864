"""The registered queries as DuckDB SQL over the same tables.

Each statement is assembled from named common table expressions, so that a
query and the ones it builds on are spelled once.
"""

from __future__ import annotations

import re

from tickloom.checks.queries import CALENDAR, DROPPED_DAY, EXPECTED, FOREST, HOLIDAYS, PAIRS, SCAN_DAYS, SPLITS, SYMBOLS
from tickloom.operators.forest import forest_sql
from tickloom.settings import ACF_LAGS, BAR_LAGS, FEATURES, PAIR_LAGS, SEQUENCE_LENGTH

LAG_LIST = ", ".join(f"lag{k}" for k in BAR_LAGS)
FEATURE_LIST = ", ".join(FEATURES)


def _round(column: str, digits: int = 8, name: str | None = None) -> str:
    return f"round({column}, {digits}) + 0.0 AS {name or column}"


def _corr(x: str, y: str, where: str = "TRUE") -> str:
    both = f"FILTER (WHERE {where} AND {x} IS NOT NULL AND {y} IS NOT NULL)"
    scale = f"(stddev_samp({x}) {both} * stddev_samp({y}) {both})"
    return f"covar_samp({x}, {y}) {both} / nullif({scale}, 0)"


# ``{ns}`` is the bar width in nanoseconds, ``{s}`` in seconds.
PARTS = {
    "quotes": """
        SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
               CAST((epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP))) * 1000 AS BIGINT) AS time_ns,
               event_id AS seq,
               CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE (10000 + CAST(floor(value / 20) AS INTEGER)) / 100.0::DOUBLE END AS best_bid,
               CAST(1 + user_id % 10 AS DOUBLE) AS best_bidsiz,
               CASE WHEN k = 99 THEN NULL
                    ELSE (10001 + CAST(floor(value / 20) AS INTEGER) + k % 3) / 100.0::DOUBLE END AS best_ask,
               CAST(1 + event_id % 7 AS DOUBLE) AS best_asksiz
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""",
    "session": """
        SELECT *, CAST(time_ns // {ns} AS INTEGER) AS bucket FROM quotes
        WHERE time_ns >= 34200000000000 AND time_ns < 57600000000000""",
    "linked": """
        SELECT *, lag(best_bid) OVER w AS prev_bid, lag(best_bidsiz) OVER w AS prev_bidsiz,
               lag(best_ask) OVER w AS prev_ask, lag(best_asksiz) OVER w AS prev_asksiz
        FROM session WINDOW w AS (PARTITION BY symbol, date ORDER BY time_ns, seq)""",
    "flow": """
        SELECT symbol, date, bucket, time_ns, seq, best_bid, best_bidsiz, best_ask, best_asksiz,
               prev_bid, prev_bidsiz, prev_ask, prev_asksiz,
               CASE WHEN best_bid < prev_bid THEN 0 ELSE best_bidsiz END
                 - CASE WHEN best_bid > prev_bid THEN 0 ELSE prev_bidsiz END AS e_bid,
               CASE WHEN best_ask < prev_ask THEN 0 ELSE prev_asksiz END
                 - CASE WHEN best_ask > prev_ask THEN 0 ELSE best_asksiz END AS e_ask
        FROM linked WHERE prev_bid IS NOT NULL AND prev_ask IS NOT NULL""",
    "bars": """
        SELECT symbol, date, bucket, sum(e_bid + e_ask) AS ofi, count(*) AS n_events,
               min(time_ns) AS bar_start, max(time_ns) AS bar_end
        FROM flow GROUP BY symbol, date, bucket""",
    "priced": """
        SELECT symbol, date, bucket, time_ns, seq, (best_bid + best_ask) / 2.0::DOUBLE AS mid, best_ask - best_bid AS spread
        FROM session WHERE best_bid > 0 AND best_ask > 0""",
    "pbars": """
        SELECT symbol, date, bucket,
               first(mid ORDER BY time_ns, seq) AS bar_open, last(mid ORDER BY time_ns, seq) AS bar_close,
               avg(mid) AS bar_vwap, avg(spread) AS avg_spread, count(*) AS n_quotes
        FROM priced GROUP BY symbol, date, bucket""",
    "rets": """
        SELECT symbol, date, bucket, bar_open, bar_close, bar_vwap, avg_spread, n_quotes,
               bar_close / before - 1 AS bar_return, ln(bar_close / before) AS log_return
        FROM (SELECT *, lag(bar_close) OVER (PARTITION BY symbol, date ORDER BY bucket) AS before,
                     count(*) OVER (PARTITION BY symbol, date) AS bars_in_day FROM pbars)
        WHERE bars_in_day >= 2""",
    "zdaily": """
        SELECT *, CASE WHEN sd IS NULL OR sd = 0 THEN 0.0::DOUBLE ELSE (ofi - m) / sd END AS ofi_z
        FROM (SELECT *, avg(ofi) OVER d AS m, stddev_samp(ofi) OVER d AS sd FROM bars WINDOW d AS (PARTITION BY symbol, date))""",
    "zexpanding": """
        SELECT symbol, date, bucket, ofi,
               CASE WHEN rn = 1 OR sd IS NULL OR sd = 0 THEN 0.0::DOUBLE ELSE (ofi - m) / sd END AS ofi_z
        FROM (SELECT *, avg(ofi) OVER d AS m, stddev_pop(ofi) OVER d AS sd, row_number() OVER d AS rn FROM bars
              WINDOW d AS (PARTITION BY symbol, date ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "ztrain": f"""
        SELECT b.*, CASE WHEN s.sd IS NULL OR s.sd = 0 THEN 0.0::DOUBLE ELSE (b.ofi - s.m) / s.sd END AS ofi_z
        FROM bars b LEFT JOIN (SELECT symbol, avg(ofi) AS m, stddev_samp(ofi) AS sd FROM bars
                               WHERE date <= DATE '{SPLITS.train_end}' GROUP BY symbol) s USING (symbol)""",
    "dataset": """
        SELECT *, {lag_columns}, lead(ofi_z) OVER h AS y_next, {split} AS split FROM ztrain
        WINDOW h AS (PARTITION BY symbol ORDER BY date, bucket)""".replace(
        "{lag_columns}", ", ".join(f"lag(ofi_z, {k}) OVER h AS lag{k}" for k in BAR_LAGS)
    ).replace(
        "{split}",
        f"CASE WHEN date <= DATE '{SPLITS.train_end}' THEN 'train' "
        f"WHEN date BETWEEN DATE '{SPLITS.val_start}' AND DATE '{SPLITS.val_end}' THEN 'val' "
        f"WHEN date >= DATE '{SPLITS.test_start}' THEN 'test' ELSE 'unknown' END",
    ),
    "complete": f"""
        SELECT * FROM dataset WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*FEATURES, 'y_next'))}""",
    "changed": """
        SELECT symbol, date, bucket, lead(ofi) OVER h AS next_ofi, lead(ofi_z) OVER h AS next_ofi_z,
               ofi - lag(ofi) OVER h AS ofi_change, ofi_z - lag(ofi_z) OVER h AS ofi_z_change
        FROM zdaily WINDOW h AS (PARTITION BY symbol ORDER BY date, bucket)""",
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY date, bucket) AS rn,
               count(*) OVER (PARTITION BY symbol, split) AS n FROM complete""",
    "pairs": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") t(symbol_a, symbol_b)",
    "wide": f"""
        SELECT p.symbol_a, p.symbol_b, a.date, a.bucket, a.split, a.ofi AS a_ofi, a.ofi_z AS a_ofi_z,
               b.ofi AS b_ofi, b.ofi_z AS b_ofi_z
        FROM pairs p JOIN dataset a ON a.symbol = p.symbol_a
        JOIN dataset b ON b.symbol = p.symbol_b AND b.date = a.date AND b.bucket = a.bucket""",
    "pairlags": "SELECT *, "
    + ", ".join(f"lag({s}_ofi_z, {k}) OVER h AS {s}_lag{k}" for s in "ab" for k in PAIR_LAGS)
    + ", lead(a_ofi_z) OVER h AS a_next, lead(b_ofi_z) OVER h AS b_next FROM wide"
    + " WINDOW h AS (PARTITION BY symbol_a, symbol_b ORDER BY date, bucket)",
    "widereturns": """
        SELECT w.*, a.bar_return AS a_ret, a.avg_spread AS a_spread, b.bar_return AS b_ret, b.avg_spread AS b_spread
        FROM wide w JOIN rets a ON a.symbol = w.symbol_a AND a.date = w.date AND a.bucket = w.bucket
        JOIN rets b ON b.symbol = w.symbol_b AND b.date = w.date AND b.bucket = w.bucket""",
    "predictions": """
        SELECT m.model, d.split, d.y_next AS y,
               CASE m.model WHEN 'persistence' THEN d.ofi_z WHEN 'zero' THEN 0.0::DOUBLE ELSE d.lag1 END AS p
        FROM dataset d CROSS JOIN (VALUES ('persistence'), ('zero'), ('lag1')) m(model)""",
    "scores": f"""
        SELECT model, split,
               avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, {_corr('y', 'p')} AS correlation,
               avg(CASE WHEN y <> 0 AND p <> 0 THEN CAST(sign(y) = sign(p) AS DOUBLE) END) AS directional_accuracy,
               count(y - p) AS n_samples
        FROM predictions GROUP BY model, split""",
    "forested": f"""
        SELECT symbol, date, bucket, split, y_next AS y, {forest_sql(FOREST)} AS p FROM complete""",
    "testscores": """
        SELECT *, CASE model WHEN 'persistence' THEN 1 WHEN 'zero' THEN 2 ELSE 3 END AS ord FROM scores WHERE split = 'test'""",
    "weekdays": f"""
        SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '{CALENDAR[0]}', TIMESTAMP '{CALENDAR[1]}', INTERVAL 1 DAY) g(d)
        WHERE isodow(d) <= 5""",
}


def _compose(final: str, bar_seconds: int = 300, extra: dict[str, str] | None = None) -> str:
    """``final`` preceded by every part it needs, directly or through another part."""
    parts = {**PARTS, **(extra or {})}
    chosen: list[str] = []

    def need(text: str) -> None:
        for name in parts:
            if name not in chosen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(parts[name])
                chosen.append(name)

    need(final)
    ctes = ",\n".join(f"{name} AS ({parts[name]})" for name in chosen)
    text = f"WITH {ctes}\n{final}" if chosen else final
    return text.replace("{ns}", str(bar_seconds * 1_000_000_000)).replace("{s}", str(bar_seconds))


def _residual_steps(source: str, y: str, xs: list[str], keys: list[str], fit: str, prefix: str) -> dict[str, str]:
    """Least squares by successive residuals, as a chain of parts ``prefix0 .. prefixN``.

    Every step removes one regressor from the target and from the regressors
    still to come; slopes come from the rows matching ``fit`` only. The last
    part holds ``y`` (observed) and ``resid``.
    """
    over = f"OVER (PARTITION BY {', '.join(keys)})" if keys else "OVER ()"
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
    kept = [*keys, "fitrow"]
    steps = {
        f"{prefix}0": f"SELECT {', '.join([*keys, f'({fit}) AS fitrow'])}, {y} AS y, {y} AS resid, "
        + ", ".join(f"{x} AS x{i}" for i, x in enumerate(xs))
        + f" FROM {source} WHERE {complete}"
    }
    for i in range(len(xs)):
        rest = ["resid", *(f"x{j}" for j in range(i + 1, len(xs)))]

        def moment(call: str) -> str:
            return f"{call} FILTER (WHERE fitrow) {over}"

        columns = ", ".join(
            f"{c} - {moment(f'avg({c})')} - coalesce({moment(f'covar_pop({c}, x{i})')} / nullif({moment(f'var_pop(x{i})')}, 0), 0)"
            f" * (x{i} - {moment(f'avg(x{i})')}) AS {c}"
            for c in rest
        )
        steps[f"{prefix}{i + 1}"] = f"SELECT {', '.join(kept)}, y, {columns} FROM {prefix}{i}"
    return steps


def _ar_sql(orders=(1, 3, 6)) -> str:
    extra, selects = {}, []
    for p in orders:
        xs = [f"lag{k}" for k in range(1, p + 1) if k in BAR_LAGS]
        steps = _residual_steps("labelled", "y_next", xs, [], "split = 'train'", f"ar{p}_")
        extra.update(steps)
        selects.append(f"SELECT 'AR({p})' AS model, y, y - resid AS p FROM {list(steps)[-1]} WHERE NOT fitrow")
    extra = {"labelled": "SELECT * FROM dataset WHERE split IN ('train', 'test')", **extra}
    extra["arpredictions"] = " UNION ALL ".join(selects)
    final = f"""
        SELECT model, {_round('avg((y - p) * (y - p))', 6, 'mse')}, {_round('avg(abs(y - p))', 6, 'mae')},
               {_round(_corr('y', 'p'), 6, 'correlation')},
               {_round('avg(CASE WHEN y <> 0 AND p <> 0 THEN CAST(sign(y) = sign(p) AS DOUBLE) END)', 6, 'directional_accuracy')},
               count(*) AS n_samples
        FROM arpredictions GROUP BY model"""
    return _compose(final, extra=extra)


def _granger_sql() -> str:
    """F-test from residual chains; the tail has a closed form when df1 is even."""
    extra, selects = {}, []
    keys = ["symbol_a", "symbol_b"]
    width = len(PAIR_LAGS)
    for direction, cause, effect in (("a_to_b", "a", "b"), ("b_to_a", "b", "a")):
        own = [f"{effect}_lag{k}" for k in PAIR_LAGS]
        other = [f"{cause}_lag{k}" for k in PAIR_LAGS]
        restricted = _residual_steps("pairlags", f"{effect}_ofi_z", own, keys, "TRUE", f"r_{direction}_")
        unrestricted = _residual_steps("pairlags", f"{effect}_ofi_z", own + other, keys, "TRUE", f"u_{direction}_")
        extra.update(restricted)
        extra.update(unrestricted)
        selects.append(
            f"SELECT symbol_a, symbol_b, '{direction}' AS direction, n, rss_r, rss_u FROM "
            f"(SELECT symbol_a, symbol_b, sum(resid * resid) AS rss_r FROM {list(restricted)[-1]} GROUP BY ALL) r JOIN "
            f"(SELECT symbol_a, symbol_b, count(*) AS n, sum(resid * resid) AS rss_u FROM {list(unrestricted)[-1]} GROUP BY ALL) u "
            "USING (symbol_a, symbol_b)"
        )
    extra["sums"] = " UNION ALL ".join(selects)
    extra["tested"] = (
        f"SELECT *, CASE WHEN fitted THEN ((rss_r - rss_u) / {width}) / (rss_u / (n - {2 * width})) END AS f, (n - {2 * width}) / 2.0 AS half, "
        f"CASE WHEN fitted THEN (rss_r - rss_u) / rss_r END AS gain FROM (SELECT *, rss_u > 1e-12 * rss_r AS fitted FROM sums) WHERE n > {2 * width}"
    )
    extra["tail"] = f"SELECT *, 2 * half / (2 * half + {width} * f) AS x FROM tested"
    assert width == 4
    p = "pow(x, half) * (1 + half * (1 - x))"
    return _compose(
        f"SELECT symbol_a, symbol_b, direction, n, {_round('f', 6, 'f_statistic')}, {_round(p, 6, 'p_value')}, "
        f"{p} < 0.05 AS significant_at_05, {_round('gain', 6, 'rss_reduction')} FROM tail",
        1800,
        extra,
    )


def _granger_1lag_sql() -> str:
    """One-lag F-test from pairwise correlations alone."""
    selects = []
    for direction, cause, effect in (("a_to_b", "a", "b"), ("b_to_a", "b", "a")):
        y, own, other = f"{effect}_ofi_z", f"{effect}_lag1", f"{cause}_lag1"
        selects.append(
            f"SELECT symbol_a, symbol_b, '{direction}' AS direction, count(*) AS n, corr({y}, {own}) AS r1, "
            f"corr({y}, {other}) AS r2, corr({own}, {other}) AS r12 FROM pairlags "
            f"WHERE {y} IS NOT NULL AND {own} IS NOT NULL AND {other} IS NOT NULL GROUP BY symbol_a, symbol_b"
        )
    extra = {
        "correlated": " UNION ALL ".join(selects),
        "shares": "SELECT *, 1 - r1 * r1 AS left_r, 1 - (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS left_u FROM correlated",
    }
    return _compose(
        f"SELECT symbol_a, symbol_b, direction, n, {_round('CASE WHEN left_u > 1e-12 * left_r THEN (left_r - left_u) / (left_u / (n - 2)) END', 6, 'f_statistic')}, "
        f"{_round('CASE WHEN left_u > 1e-12 * left_r THEN (left_r - left_u) / left_r END', 6, 'rss_reduction')} FROM shares WHERE n > 2",
        1800,
        extra,
    )


def _lead_lag_sql() -> str:
    selects = []
    for direction, leader, follower in (("a_leads_b", "a", "b"), ("b_leads_a", "b", "a")):
        for k in PAIR_LAGS:
            x, y = f"{leader}_lag{k}", f"{follower}_ofi_z"
            selects.append(
                f"SELECT symbol_a, symbol_b, '{direction}' AS direction, CAST({k} AS INTEGER) AS lag, "
                f"count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS n, "
                f"{_round(_corr(x, y), 8, 'correlation')} FROM pairlags GROUP BY symbol_a, symbol_b"
            )
    return _compose("SELECT * FROM lagged WHERE n > 100", 1800, {"lagged": " UNION ALL ".join(selects)})


def _acf_sql() -> str:
    shifted = "SELECT symbol, ofi_z, " + ", ".join(f"lag(ofi_z, {k}) OVER h AS p{k}" for k in ACF_LAGS)
    extra = {
        "past": shifted + " FROM ztrain WHERE ofi_z IS NOT NULL WINDOW h AS (PARTITION BY symbol ORDER BY date, bucket)",
        "cells": " UNION ALL ".join(
            f"SELECT symbol, CAST({k} AS INTEGER) AS lag, count(p{k}) AS n, {_round(_corr('ofi_z', f'p{k}'), 8, 'correlation')} "
            f"FROM past GROUP BY symbol HAVING count(*) >= 100"
            for k in ACF_LAGS
        ),
    }
    return _compose("SELECT * FROM cells WHERE n > 0", extra=extra)


def _describe_sql() -> str:
    def one(c: str) -> str:
        v = f"CAST({c} AS DOUBLE)"
        quartiles = ", ".join(_round(f"quantile_cont({v}, {q})", 6, f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75))
        return (
            f"SELECT '{c}' AS column_name, count({c}) AS count, {_round(f'avg({v})', 6, 'mean')}, "
            f"{_round(f'stddev_samp({v})', 6, 'std')}, {_round(f'min({v})', 6, 'min')}, {quartiles}, {_round(f'max({v})', 6, 'max')} FROM bars"
        )

    return _compose(" UNION ALL ".join(one(c) for c in ("ofi", "n_events", "bucket")))


def _rank_ic_sql() -> str:
    def ranks(column: str) -> str:
        return (
            f"rank() OVER (PARTITION BY model, split ORDER BY {column} + 0.0)"
            f" + (count(*) OVER (PARTITION BY model, split, {column} + 0.0) - 1) / 2.0"
        )

    extra = {
        "ranked": f"SELECT model, split, CAST({ranks('y')} AS DOUBLE) AS ry, CAST({ranks('p')} AS DOUBLE) AS rp FROM predictions"
        " WHERE y IS NOT NULL AND p IS NOT NULL"
    }
    value = f"coalesce({_corr('ry', 'rp')}, 0)"
    return _compose(f"SELECT model, split, {_round(value, 8, 'information_coefficient')} FROM ranked GROUP BY model, split", extra=extra)


def _best_sql() -> str:
    picks = []
    for metric, way in (("mse", ""), ("mae", ""), ("correlation", "DESC"), ("directional_accuracy", "DESC")):
        picks.append(
            f"SELECT '{metric}' AS metric, model AS best, {_round(metric, 8, 'value')} FROM "
            f"(SELECT *, row_number() OVER (ORDER BY {metric} {way}, ord) AS place FROM testscores WHERE {metric} IS NOT NULL) WHERE place = 1"
        )
    return _compose(" UNION ALL ".join(picks))


def _forest_importance_sql() -> str:
    """Splits walked level by level: one join of rows and nodes per level of the trees."""
    rows = ", ".join(
        "(" + ", ".join("NULL" if v is None else repr(v) for v in row.values()) + ")" for row in FOREST
    )
    trees = sorted({row["tree"] for row in FOREST})
    over = ", ".join(f"y_next - ({forest_sql([r for r in FOREST if r['tree'] < t])}) AS over{t}" for t in trees)
    value = "CASE n.feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in FEATURES) + " END"
    left = " ".join(f"WHEN {t} THEN over{t}" for t in trees)
    steps = {
        "forest": f"SELECT * FROM (VALUES {rows}) t({', '.join(FOREST[0])})",
        "measured": f"SELECT row_number() OVER () AS id, {FEATURE_LIST}, {over} FROM complete WHERE split = 'train'",
        "at0": f"SELECT m.*, n.tree, n.node, n.feature, {value} <= n.threshold AS is_left FROM measured m CROSS JOIN forest n WHERE n.node = 0",
    }
    columns = f"m.id, {', '.join(f'm.{c}' for c in FEATURES)}, {', '.join(f'm.over{t}' for t in trees)}"
    deepest = max(row["node"] for row in FOREST).bit_length()
    for level in range(1, deepest):
        steps[f"at{level}"] = (
            f"SELECT {columns}, n.tree, n.node, n.feature, {value.replace('THEN ', 'THEN m.')} <= n.threshold AS is_left "
            f"FROM at{level - 1} m JOIN forest n ON n.tree = m.tree AND n.node = 2 * m.node + CASE WHEN m.is_left THEN 1 ELSE 2 END "
            "WHERE n.feature IS NOT NULL"
        )
    walked = " UNION ALL BY NAME ".join(f"SELECT * FROM at{level}" for level in range(deepest) if f"at{level}" in steps)
    steps["walked"] = f"SELECT tree, node, feature, is_left, CASE tree {left} END AS over FROM ({walked})"
    steps["sides"] = (
        "SELECT tree, node, feature, count(*) AS n, count(*) FILTER (WHERE is_left) AS nl, "
        "coalesce(sum(over) FILTER (WHERE is_left), 0) AS l, coalesce(sum(over) FILTER (WHERE NOT is_left), 0) AS r FROM walked GROUP BY ALL"
    )
    steps["gains"] = (
        "SELECT feature, avg(coalesce(l * l / nullif(nl, 0), 0) + coalesce(r * r / nullif(n - nl, 0), 0) - (l + r) * (l + r) / n) AS gain "
        "FROM sides GROUP BY feature"
    )
    steps["shares"] = "SELECT feature, gain / sum(gain) OVER () AS importance FROM gains"
    return _compose(
        f"SELECT feature, {_round('importance', 6)}, CAST(row_number() OVER (ORDER BY shares.importance DESC, feature) AS INTEGER) AS place FROM shares",
        extra=steps,
    )


def _days_as_text(sql: str, columns: tuple[str, ...]) -> str:
    shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({shown}) FROM ({sql}) shown"


# Day and time columns of a result; days are compared as text.
DAY_COLUMNS = {
    "bar_time": ("date", "datetime"),
    "dataset_profile": ("first_date", "last_date"),
    **{
        name: ("date",)
        for name in (
            "quote_view", "quote_scan", "daily_tables_scan", "ofi_events", "ofi_bars", "price_bars", "price_bars_rn", "price_bars_full", "bar_returns",
            "trading_calendar", "stored_calendar", "partition_discovery", "completeness", "bar_dedup", "zscore_daily", "zscore_expanding",
            "zscore_train", "lag_features", "bucketed_lags", "ofi_changes", "pair_bars", "pair_returns", "ar1_ols", "bar_files_roundtrip", "bar_files_scan", "forest_scores",
        )
    },
}


# Year, separator, month and day of a table's suffix.
_DATE = "^([0-9]{4})(-?)(1[0-2]|0[1-9]|[1-9])-?(3[01]|[12][0-9]|0[1-9]|[1-9])$"


def statements() -> dict[str, str]:
    """One DuckDB statement per registered query that SQL can express."""
    spelled = _statements()
    # The same rows by another road.
    spelled |= {"stored_calendar": spelled["trading_calendar"], "bucketed_lags": spelled["lag_features"], "comparison_document": spelled["best_model"]}
    return {name: _days_as_text(sql, DAY_COLUMNS[name]) if name in DAY_COLUMNS else sql for name, sql in spelled.items()}


def _statements() -> dict[str, str]:
    key = "symbol, date, bucket"
    pbar = ["bar_open", "bar_close", "bar_vwap", "avg_spread"]
    price_list = ", ".join(map(_round, pbar))
    symbols = ", ".join(f"'{s}'" for s in SYMBOLS)
    holidays = ", ".join(f"DATE '{d}'" for d in HOLIDAYS)
    score_list = ", ".join(map(_round, ("mse", "mae", "correlation", "directional_accuracy")))
    change_lags = ", ".join(
        _round(f"lag(ofi_z_change, {k}) OVER h", 8, f"ofi_change_lag{k}") for k in (1, 2, 3, 6, 12)
    )
    pair_list = ", ".join(map(_round, ("a_ofi", "a_ofi_z", "b_ofi", "b_ofi_z")))
    pair_lags = ", ".join(_round(f"{s}_lag{k}") for s in "ab" for k in PAIR_LAGS)
    return_shifts = ", ".join(
        _round(f"lag({s}_{stem}, {k}) OVER h", 8, f"{s}_{out}_lag{k}")
        for s in "ab" for stem, out in (("ret", "ret"), ("ofi_z", "ofi")) for k in PAIR_LAGS
    )
    sequence_steps = ", ".join(_round(f"b.{c}", 8, c) for c in FEATURES)
    return {
        "quote_view": _compose(
            f"SELECT {key}, time_ns, seq, {_round('mid')}, {_round('spread')} FROM priced WHERE upper(trim(symbol)) IN "
            f"({', '.join(repr(s.upper()) for s in SYMBOLS)})"
        ),
        "daily_tables_scan": _compose(
            "SELECT upper(symbol) AS symbol, time_ns, seq, best_bid, best_bidsiz, best_ask, best_asksiz, date FROM quotes "
            f"WHERE symbol IN ('click', 'view') AND date BETWEEN DATE '{SCAN_DAYS[0]}' AND DATE '{SCAN_DAYS[1]}' "
            f"AND date <> DATE '{DROPPED_DAY}'"
        ),
        "quote_scan": _compose(
            "SELECT upper(symbol) AS symbol, time_ns, seq, best_bid, best_bidsiz, best_ask, best_asksiz, date FROM quotes "
            f"WHERE symbol IN ('click', 'view') AND date BETWEEN DATE '{SCAN_DAYS[0]}' AND DATE '{SCAN_DAYS[1]}'"
        ),
        "ofi_events": _compose("SELECT * REPLACE (e_bid + 0.0 AS e_bid, e_ask + 0.0 AS e_ask) FROM flow"),
        "ofi_bars": _compose("SELECT * FROM bars"),
        "price_bars": _compose(f"SELECT {key}, {price_list}, n_quotes FROM pbars"),
        "price_bars_rn": _compose(f"SELECT {key}, {price_list}, n_quotes FROM pbars"),
        "price_bars_full": _compose(
            f"""SELECT DISTINCT symbol, date, bucket,
                {_round('first_value(mid) OVER w', 8, 'bar_open')}, {_round('last_value(mid) OVER w', 8, 'bar_close')},
                {_round('avg(mid) OVER d', 8, 'bar_vwap')}, {_round('min(mid) OVER d', 8, 'bar_low')},
                {_round('max(mid) OVER d', 8, 'bar_high')}, CAST(sum(copies) OVER d AS BIGINT) AS n_quotes,
                {_round('avg(spread) OVER d', 8, 'avg_spread')}
            FROM moments
            WINDOW w AS (PARTITION BY symbol, date, bucket ORDER BY time_ns, seq_low ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
                   d AS (PARTITION BY symbol, date, bucket)""",
            extra={
                "moments": f"SELECT {key}, mid, time_ns, count(*) AS copies, avg(spread) AS spread, min(seq) AS seq_low "
                f"FROM priced GROUP BY {key}, mid, time_ns"
            },
        ),
        "bar_returns": _compose(f"SELECT {key}, {price_list}, n_quotes, {_round('bar_return')}, {_round('log_return')} FROM rets"),
        "return_stats": _compose(
            f"SELECT symbol, count(bar_return) AS n, {_round('avg(bar_return) * 10000', 6, 'mean_bps')}, "
            f"{_round('stddev_samp(bar_return) * 10000', 6, 'std_bps')} FROM rets GROUP BY symbol"
        ),
        "trading_calendar": _compose(
            f"""SELECT w.date, CASE WHEN q.date IS NOT NULL THEN 'present' WHEN w.date IN ({holidays}) THEN 'holiday'
                ELSE 'missing' END AS status
            FROM weekdays w LEFT JOIN (SELECT DISTINCT date FROM quotes) q ON q.date = w.date"""
        ),
        "partition_discovery": _compose(
            f"""SELECT n.date, coalesce(min(n.table_name) FILTER (WHERE regexp_full_match(n.table_name, 'nbbom_[0-9]{{8}}')), min(n.table_name)) AS table_name,
                strftime(n.date, '%Y%m%d') AS date_key
            FROM (SELECT table_name, CAST(try_strptime(
                      lpad(regexp_extract(suffix, '{_DATE}', 1), 4, '0') || '-' || lpad(regexp_extract(suffix, '{_DATE}', 3), 2, '0')
                      || '-' || lpad(regexp_extract(suffix, '{_DATE}', 4), 2, '0'), '%Y-%m-%d') AS DATE) AS date
                  FROM (SELECT DISTINCT suffix, 'nbbom_' || suffix AS table_name FROM (
                      SELECT strftime(ts, '%Y%m%d') AS suffix FROM events
                      UNION ALL SELECT strftime(ts, '%Y-%m-%d') FROM events
                      UNION ALL SELECT strftime(ts, '%Y-%-m-%-d') FROM events
                      UNION ALL SELECT strftime(ts + INTERVAL 31 DAY, '%Y%m%-d') FROM events
                      UNION ALL SELECT event_type FROM events
                      UNION ALL SELECT '2024' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') FROM events)
                  WHERE regexp_full_match(suffix, '[0-9]{{4}}-[^-]+-[^-]+|[0-9]+'))) n
            JOIN weekdays ON weekdays.date = n.date GROUP BY n.date"""
        ),
        "completeness": _compose(
            f"""SELECT t.symbol, t.date, coalesce(b.n_bars, 0) AS n_bars,
                   CASE WHEN b.n_bars IS NULL THEN 'skipped' ELSE 'extracted' END AS status
            FROM (SELECT s.symbol, d.date FROM (SELECT unnest([{', '.join(repr(x) for x in EXPECTED)}]) AS symbol) s
                  CROSS JOIN (SELECT DISTINCT date FROM quotes) d) t
            LEFT JOIN (SELECT symbol, date, count(*) AS n_bars FROM bars GROUP BY symbol, date) b
            ON b.symbol = t.symbol AND b.date = t.date"""
        ),
        "bar_dedup": _compose("SELECT * FROM bars UNION SELECT * FROM bars"),
        "bar_time": _compose(
            f"""SELECT {key}, CAST(date AS TIMESTAMP) + bucket * INTERVAL 300 SECOND AS datetime,
                strftime(CAST(date AS TIMESTAMP) + bucket * INTERVAL 300 SECOND, '%H:%M') AS bar_time,
                strftime(date, '%Y%m%d') AS date_key FROM bars"""
        ),
        "zscore_daily": _compose(f"SELECT {key}, {_round('ofi')}, {_round('ofi_z')} FROM zdaily"),
        "zscore_expanding": _compose(f"SELECT {key}, {_round('ofi')}, {_round('ofi_z')} FROM zexpanding"),
        "zscore_train": _compose(f"SELECT {key}, {_round('ofi')}, {_round('ofi_z')} FROM ztrain"),
        "lag_features": _compose(
            f"SELECT {key}, strftime(CAST(date AS TIMESTAMP) + bucket * INTERVAL 300 SECOND, '%H:%M') AS bar_time, "
            f"{', '.join(map(_round, FEATURES))}, {_round('y_next')}, split FROM complete"
        ),
        "ofi_changes": _compose(
            f"SELECT {key}, {_round('next_ofi')}, {_round('next_ofi_z')}, {_round('CAST(sign(next_ofi_z) AS DOUBLE)', 8, 'next_ofi_sign')}, "
            f"{_round('ofi_change')}, {_round('ofi_z_change')}, {change_lags} FROM changed "
            "WINDOW h AS (PARTITION BY symbol ORDER BY date, bucket)"
        ),
        "describe_ofi": _describe_sql(),
        "dataset_profile": _compose(
            f"SELECT symbol, split, count(*) AS n_rows, count(*) FILTER (WHERE "
            f"{' AND '.join(f'{c} IS NOT NULL' for c in (*FEATURES, 'y_next'))}) AS n_valid, min(date) AS first_date, max(date) AS last_date "
            "FROM dataset GROUP BY symbol, split"
        ),
        "sequences": _compose(
            f"SELECT a.symbol, a.split, a.rn AS row_no, CAST(b.rn - a.rn AS INTEGER) AS step, {_round('t.y_next', 8, 'y')}, {sequence_steps} "
            f"FROM numbered a JOIN numbered b ON b.symbol = a.symbol AND b.split = a.split AND b.rn >= a.rn AND b.rn < a.rn + {SEQUENCE_LENGTH} "
            f"JOIN numbered t ON t.symbol = a.symbol AND t.split = a.split AND t.rn = a.rn + {SEQUENCE_LENGTH}"
        ),
        "pair_bars": _compose(
            f"SELECT symbol_a, symbol_b, date, bucket, split, {pair_list}, {pair_lags}, {_round('a_next')}, {_round('b_next')} FROM pairlags", 1800
        ),
        "pair_returns": _compose(
            f"SELECT symbol_a, symbol_b, date, bucket, split, {pair_list}, "
            f"{', '.join(map(_round, ('a_ret', 'a_spread', 'b_ret', 'b_spread')))}, {return_shifts}, "
            f"{_round('lead(a_ret) OVER h', 8, 'a_ret_next')}, {_round('lead(b_ret) OVER h', 8, 'b_ret_next')} FROM widereturns "
            "WINDOW h AS (PARTITION BY symbol_a, symbol_b ORDER BY date, bucket)",
            1800,
        ),
        "pair_corr": _compose(
            f"SELECT symbol_a, symbol_b, count(*) AS n, {_round(_corr('a_ofi_z', 'b_ofi_z'), 8, 'correlation')} FROM wide "
            "GROUP BY symbol_a, symbol_b HAVING count(*) > 100",
            1800,
        ),
        "lead_lag": _lead_lag_sql(),
        "acf": _acf_sql(),
        "metrics": _compose(f"SELECT model, split, {score_list}, n_samples FROM scores"),
        "rank_ic": _rank_ic_sql(),
        "best_model": _best_sql(),
        "model_report": _compose(
            """SELECT upper(model) AS model, coalesce(printf('%.6f', mse), 'nan') AS mse, coalesce(printf('%.6f', mae), 'nan') AS mae,
                   coalesce(printf('%.4f', correlation), 'nan') AS correlation,
                   coalesce(printf('%.2f%%', directional_accuracy * 100), 'nan%') AS directional_acc, n_samples
            FROM testscores"""
        ),
        "forest_scores": _compose(f"SELECT {key}, split, {_round('p')} FROM forested"),
        "forest_eval": _compose(
            f"""SELECT split, {_round('avg((y - p) * (y - p))', 8, 'mse')}, {_round('avg(abs(y - p))', 8, 'mae')},
                   {_round(_corr('y', 'p'), 8, 'correlation')},
                   {_round("avg(CASE WHEN y <> 0 AND p <> 0 THEN CAST(sign(y) = sign(p) AS DOUBLE) END)", 8, 'directional_accuracy')},
                   count(y - p) AS n_samples FROM forested GROUP BY split"""
        ),
        "forest_importance": _forest_importance_sql(),
        "ar1_ols": _compose(
            f"""SELECT {key}, {_round('y_next', 6, 'y')}, {_round('f.a + f.b * lag1', 6, 'p')}
            FROM dataset, (SELECT regr_slope(y_next, lag1) AS b, regr_intercept(y_next, lag1) AS a FROM dataset WHERE split = 'train') f
            WHERE split = 'test' AND lag1 IS NOT NULL AND y_next IS NOT NULL"""
        ),
        "ar_p": _ar_sql(),
        "granger_1lag": _granger_1lag_sql(),
        "granger": _granger_sql(),
        "suite_records": _compose(
            f"""SELECT model AS experiment, 'forecasts of the next bar' AS description, 'y_next' AS target, 'forecast:' || model AS features,
                   n_samples AS n_test, {score_list}, CAST(NULL AS DOUBLE) AS information_coefficient, n_samples, 1.0::DOUBLE AS importance,
                   300 AS bar_seconds, 2 AS lags_1, '16:00' AS session_close, CAST(NULL AS INTEGER) AS seed, CAST(NULL AS VARCHAR) AS absent
            FROM testscores"""
        ),
        "report_details": _compose(
            f"""SELECT upper(model) AS model, '2024-02-01T00:00:00' AS timestamp, 'bar_seconds=300, best_epoch=' || best AS params,
                   {_round('train_loss[-1]', 6, 'final_train_loss')}, {_round('val_loss[-1]', 6, 'final_val_loss')}, best AS best_epoch
            FROM (SELECT *, CAST(list_position(val_loss, list_min(val_loss)) AS VARCHAR) AS best FROM (
                SELECT model, list(loss ORDER BY date) FILTER (WHERE split = 'train') AS train_loss,
                       list(loss ORDER BY date) FILTER (WHERE split = 'val') AS val_loss
                FROM (SELECT model, split, date, avg((y_next - p) * (y_next - p)) AS loss
                      FROM (SELECT m.model, d.split, d.date, d.y_next,
                                   CASE m.model WHEN 'persistence' THEN d.ofi_z WHEN 'zero' THEN 0.0::DOUBLE ELSE d.lag1 END AS p
                            FROM dataset d CROSS JOIN (VALUES ('persistence'), ('zero'), ('lag1')) m(model) WHERE d.split IN ('train', 'val'))
                      GROUP BY model, split, date)
                WHERE loss IS NOT NULL GROUP BY model))"""
        ),
        "metric_json_roundtrip": _compose(f"SELECT model, split, {score_list}, n_samples FROM scores"),
        "bar_files_scan": _compose("SELECT date, symbol, bucket, ofi, n_events, bar_start, bar_end FROM bars"),
        "combined_order": _compose("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM bars"),
        "bar_files_roundtrip": _compose("SELECT date, symbol, bucket, ofi, n_events, bar_start, bar_end, 1 AS n_daily, 1 AS n_combined FROM bars"),
    }
