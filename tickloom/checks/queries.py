"""Registered queries: every operator over the whole given tables.

The tables hold no quotes, so they are derived from ``events`` (see
``quotes_from_events``); all else follows from those quotes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as fn
from tickloom.operators import calendar, evaluation, events, features, forest, linear, models, pairs, prices
from tickloom.operators.events import BAR_KEYS
from tickloom.plans import reports, suites
from tickloom.plans.dataset import bucketed_dataset, modelling_dataset
from tickloom.plans.training import train_trees
from tickloom.settings import FEATURES, TARGET, BarSpec, SplitDates, materialize, scratch_path
from tickloom.sources import bars as bar_files
from tickloom.sources import metrics as metric_files
from tickloom.sources import tables
from tickloom.sources.quotes import read_event_quotes, read_quotes

SPLITS = SplitDates(date(2024, 1, 20), date(2024, 1, 21), date(2024, 1, 25), date(2024, 1, 26))
SYMBOLS = ("click", "error", "purchase", "signup", "view")
# One symbol of these has no bars.
EXPECTED = (*SYMBOLS, "refund")
PAIRS = (
    ("click", "error"), ("click", "purchase"), ("click", "signup"), ("click", "view"), ("error", "purchase"),
    ("error", "signup"), ("error", "view"), ("purchase", "signup"), ("purchase", "view"), ("signup", "view"),
)
PAIR_SPEC = BarSpec(bar_seconds=1800)
SCAN_DAYS = (date(2024, 1, 5), date(2024, 1, 20))
DROPPED_DAY = date(2024, 1, 10)
CALENDAR = (date(2024, 1, 1), date(2024, 2, 29))
HOLIDAYS = (date(2024, 1, 1), date(2024, 1, 15), date(2024, 2, 19))
# A fixed forest of six trees over the features of the dataset.
FOREST = [json.loads(line) for line in (Path(__file__).parent / "forest.json").read_text().splitlines()]
FORECASTS = {"persistence": "ofi_z", "zero": None, "lag1": "lag1"}


def _comparable(df: DataFrame, digits: int = 8) -> DataFrame:
    """Form in which two engines can be compared: rounded doubles without -0.0, days as text."""

    def plain(name: str, kind: str) -> Column:
        if kind == "double":
            return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)
        if kind in ("date", "timestamp_ntz"):
            return F.col(name).cast("string").alias(name)
        return F.col(name)

    return df.select(*(plain(name, kind) for name, kind in df.dtypes))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_event_quotes(spark, sf_dir)


def bars(spark: SparkSession, sf_dir: str, spec: BarSpec = BarSpec()) -> DataFrame:
    return events.ofi_bars(quotes(spark, sf_dir), spec)


def stored_bars(spark: SparkSession, sf_dir: str, spec: BarSpec = BarSpec()) -> DataFrame:
    """Bars written and read back, the hand-off between the extraction and later jobs."""
    return materialize(bars(spark, sf_dir, spec), "bars")


def dataset(spark: SparkSession, sf_dir: str, spec: BarSpec = BarSpec(), normalization: str = "training_set") -> DataFrame:
    """Modelling dataset from stored bars."""
    return modelling_dataset(stored_bars(spark, sf_dir, spec), SPLITS, normalization, spec.bar_seconds)


def stored_dataset(
    spark: SparkSession, sf_dir: str, spec: BarSpec = BarSpec(), normalization: str = "training_set"
) -> DataFrame:
    """Dataset written and read back, for jobs that read it more than once."""
    return materialize(dataset(spark, sf_dir, spec, normalization), "dataset")


def pair_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_dataset(spark, sf_dir, PAIR_SPEC)
    return pairs.pair_bars(stored, pairs.pair_table(spark, PAIRS))


def return_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_dataset(spark, sf_dir, PAIR_SPEC)
    returns = materialize(prices.bar_returns(prices.price_bars(quotes(spark, sf_dir), PAIR_SPEC)), "returns")
    return pairs.pair_returns(stored, returns, pairs.pair_table(spark, PAIRS))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-free predictions of the next bar: the last value, zero, the value before."""
    rows = dataset(spark, sf_dir)

    def guess(column: str | None) -> Column:
        return F.lit(0.0) if column is None else F.col(column)

    entries = F.array(*(F.struct(F.lit(name).alias("model"), guess(c).alias("p")) for name, c in FORECASTS.items()))
    return rows.select("split", F.col(TARGET).alias("y"), F.inline(entries))


def forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test metrics per forecast, in the order the forecasts are listed."""
    order = F.array_position(F.array(*(F.lit(name) for name in FORECASTS)), F.col("model"))
    tested = forecasts(spark, sf_dir).filter("split = 'test'")
    return evaluation.prediction_metrics(tested, ["model"]).withColumn("ord", order)


def quote_view(spark, sf_dir):
    listed = quotes(spark, sf_dir).filter(fn.symbol_in(F.col("symbol"), [f" {s} " for s in SYMBOLS]))
    return _comparable(prices.priced_quotes(listed))


def quote_scan(spark, sf_dir):
    """Quotes stored by day and read back for some symbols and days."""
    path = scratch_path(spark, "quotes")
    stored = quotes(spark, sf_dir).withColumn("symbol", F.upper("symbol"))
    stored.hint("rebalance", "date").write.partitionBy("date").parquet(path)
    return _comparable(read_quotes(spark, path, [" click", "VIEW ", "none"], *SCAN_DAYS))


def daily_tables_scan(spark, sf_dir):
    """Quotes stored as one table a day, read back for some symbols and days; one day's table is dropped."""
    path = scratch_path(spark, "daily-tables")
    schema = f"daily_{path.rsplit('-', 1)[1]}"
    stored = quotes(spark, sf_dir).withColumn("symbol", F.upper("symbol")).withColumn("day", fn.date_key(F.col("date"))).drop("date")
    stored.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{path}-database'")
    days = spark.read.format("binaryFile").load(path).select("day").distinct().collect()  # one row per day
    for row in days:
        if row.day != int(f"{DROPPED_DAY:%Y%m%d}"):
            spark.sql(f"CREATE TABLE {schema}.nbbom_{row.day} USING parquet LOCATION '{path}/day={row.day}'")
    spark.sql(f"CREATE VIEW {schema}.nbbom_notes AS SELECT 1 AS x")
    return _comparable(tables.read_daily_tables(spark, schema, *SCAN_DAYS, [" click", "VIEW ", "none"]))


def ofi_events(spark, sf_dir):
    return _comparable(events.ofi_events(quotes(spark, sf_dir)))


def ofi_bars(spark, sf_dir):
    return _comparable(bars(spark, sf_dir))


def price_bars(spark, sf_dir):
    return _comparable(prices.price_bars(quotes(spark, sf_dir)))


def price_bars_rn(spark, sf_dir):
    return _comparable(prices.price_bars_ranked(quotes(spark, sf_dir)))


def price_bars_full(spark, sf_dir):
    return _comparable(prices.price_bars_full(quotes(spark, sf_dir)))


def bar_returns(spark, sf_dir):
    return _comparable(prices.bar_returns(prices.price_bars(quotes(spark, sf_dir))))


def return_stats(spark, sf_dir):
    return _comparable(prices.return_stats(prices.bar_returns(prices.price_bars(quotes(spark, sf_dir)))), 6)


def trading_calendar(spark, sf_dir):
    days = calendar.weekdays(spark, *CALENDAR)
    return _comparable(calendar.reconcile_calendar(days, quotes(spark, sf_dir), HOLIDAYS))


def stored_calendar(spark, sf_dir):
    """The same from the folders of stored quotes, without opening their files."""
    path = scratch_path(spark, "quotes")
    quotes(spark, sf_dir).hint("rebalance", "date").write.partitionBy("date").parquet(path)
    return _comparable(calendar.reconcile_calendar(calendar.weekdays(spark, *CALENDAR), calendar.stored_days(spark, path), HOLIDAYS))


def partition_discovery(spark, sf_dir):
    """Daily-table names spelled from the events, many of them not dates, matched to a calendar."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.col("ts").cast("date")
    suffixes = F.array(
        fn.date_key(day),
        day.cast("string"),
        F.date_format(day, "y-M-d"),
        F.date_format(F.date_add(day, 31), "yMMd"),
        F.col("event_type"),
        F.concat(F.lit("2024"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")),
    )
    spelled = F.transform(suffixes, lambda suffix: F.concat(F.lit("nbbom_"), suffix))
    names = rows.select(F.explode(spelled).alias("table_name")).distinct()
    found = calendar.dates_from_names(names)
    wanted = calendar.existing_days(calendar.weekdays(spark, *CALENDAR), found)
    key = fn.date_key(fn.parse_date(F.col("date").cast("string"))).alias("date_key")
    return _comparable(found.join(wanted, "date").select("date", "table_name", key))


def completeness(spark, sf_dir):
    stored = stored_bars(spark, sf_dir)
    return _comparable(calendar.completeness(stored, quotes(spark, sf_dir).select("date").distinct(), EXPECTED))


def bar_dedup(spark, sf_dir):
    stored = stored_bars(spark, sf_dir)
    return _comparable(features.dedup_bars(bar_files.coerce_bars(stored.unionByName(stored))))


def bar_time(spark, sf_dir):
    timed = features.add_bar_time(bars(spark, sf_dir))
    return _comparable(timed.select(*BAR_KEYS, "datetime", "bar_time", fn.date_key(F.col("date")).alias("date_key")))


def zscore_daily(spark, sf_dir):
    return _comparable(features.zscore_daily(bars(spark, sf_dir)).select(*BAR_KEYS, "ofi", "ofi_z"))


def zscore_expanding(spark, sf_dir):
    return _comparable(features.zscore_expanding(bars(spark, sf_dir)).select(*BAR_KEYS, "ofi", "ofi_z"))


def zscore_train(spark, sf_dir):
    return _comparable(features.zscore_training(stored_bars(spark, sf_dir), SPLITS.train_end).select(*BAR_KEYS, "ofi", "ofi_z"))


def lag_features(spark, sf_dir):
    complete = features.complete_cases(dataset(spark, sf_dir))
    return _comparable(complete.select(*BAR_KEYS, "bar_time", *FEATURES, TARGET, "split"))


def bucketed_lags(spark, sf_dir):
    """The same over bars stored by symbol in buckets."""
    path = scratch_path(spark, "bucketed")
    table = f"bars_{path.rsplit('-', 1)[1]}"
    bar_files.write_bucketed(bars(spark, sf_dir), table, 8, path)
    complete = features.complete_cases(bucketed_dataset(spark.table(table), SPLITS))
    return _comparable(complete.select(*BAR_KEYS, "bar_time", *FEATURES, TARGET, "split"))


def ofi_changes(spark, sf_dir):
    changes = features.add_ofi_changes(stored_dataset(spark, sf_dir, normalization="daily"))
    names = ["next_ofi", "next_ofi_z", "next_ofi_sign", "ofi_change", "ofi_z_change"]
    return _comparable(changes.select(*BAR_KEYS, *names, *(f"ofi_change_lag{k}" for k in (1, 2, 3, 6, 12))))


def describe_ofi(spark, sf_dir):
    return _comparable(evaluation.describe_columns(stored_bars(spark, sf_dir), ["ofi", "n_events", "bucket"]), 6)


def dataset_profile(spark, sf_dir):
    return _comparable(evaluation.dataset_profile(dataset(spark, sf_dir)))


def sequences(spark, sf_dir):
    blocks = features.sliding_sequences(stored_dataset(spark, sf_dir))
    steps = blocks.select("symbol", "split", "row_no", "y", F.posexplode("x").alias("step", "values"))
    return _comparable(
        steps.select(
            "symbol", "split", "row_no", "step", "y", *(F.col("values")[i].alias(c) for i, c in enumerate(FEATURES))
        )
    )


def pair_bars(spark, sf_dir):
    return _comparable(pair_frame(spark, sf_dir))


def pair_returns(spark, sf_dir):
    return _comparable(return_frame(spark, sf_dir))


def pair_corr(spark, sf_dir):
    return _comparable(pairs.contemporaneous_corr(pair_frame(spark, sf_dir)))


def lead_lag(spark, sf_dir):
    return _comparable(pairs.lead_lag_corr(pair_frame(spark, sf_dir)))


def acf(spark, sf_dir):
    return _comparable(pairs.autocorrelation(stored_dataset(spark, sf_dir)))


def metrics(spark, sf_dir):
    return _comparable(evaluation.prediction_metrics(forecasts(spark, sf_dir), ["model", "split"]))


def rank_ic(spark, sf_dir):
    return _comparable(evaluation.rank_ic(materialize(forecasts(spark, sf_dir), "forecasts"), ["model", "split"]))


def best_model(spark, sf_dir):
    return _comparable(evaluation.best_models(forecast_scores(spark, sf_dir)))


def model_report(spark, sf_dir):
    return evaluation.metrics_table(forecast_scores(spark, sf_dir))


def ar1_ols(spark, sf_dir):
    stored = stored_dataset(spark, sf_dir)
    train, _, test = features.split_frames(stored)
    return _comparable(linear.ols_predict(train, test, ["lag1"]).select(*BAR_KEYS, F.col(TARGET).alias("y"), "p"), 6)


def ar_p(spark, sf_dir):
    return _comparable(linear.ar_baselines(stored_dataset(spark, sf_dir)), 6)


def granger_1lag(spark, sf_dir):
    tests = linear.granger_tests(pair_frame(spark, sf_dir), [1])
    return _comparable(tests.select("symbol_a", "symbol_b", "direction", "n", "f_statistic", "rss_reduction"), 6)


def granger(spark, sf_dir):
    return _comparable(linear.granger_tests(pair_frame(spark, sf_dir)), 6)


def gbt_eval(spark, sf_dir):
    """Trees trained on stored data and scored on every split, by way of the saved model."""
    path = scratch_path(spark, "training")
    stored = stored_dataset(spark, sf_dir)
    train_trees(stored, f"{path}/trees_metrics.json", f"{path}/model")
    return models.evaluate_splits(models.load_model(f"{path}/model"), stored)


def stored_forest(spark: SparkSession) -> list[dict]:
    """The fixed forest through the model sink and back."""
    path = scratch_path(spark, "forest")
    forest.write_forest(spark.createDataFrame([tuple(row.values()) for row in FOREST], forest.NODE_SCHEMA), path)
    return forest.read_forest(spark, path, FEATURES)


def forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    complete = features.complete_cases(dataset(spark, sf_dir))
    return complete.withColumn("p", forest.forest_column(stored_forest(spark)))


def forest_scores(spark, sf_dir):
    """Every complete row scored by a stored forest, as an expression of the JVM."""
    return _comparable(forest_rows(spark, sf_dir).select(*BAR_KEYS, "split", "p"))


def forest_eval(spark, sf_dir):
    """A stored forest on every split in one pass."""
    scored = forest_rows(spark, sf_dir).select("split", F.col(TARGET).alias("y"), "p")
    return _comparable(evaluation.prediction_metrics(scored, ["split"]))


def forest_importance(spark, sf_dir):
    """Importances of a stored forest, measured on the train rows, largest first."""
    train = features.complete_cases(dataset(spark, sf_dir)).filter("split = 'train'")
    gains = materialize(forest.node_gains(train, stored_forest(spark), TARGET), "node-gains")
    ranked = forest.importance_ranking(gains)
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    return _comparable(ranked.withColumn("place", place), 6)


def importance(spark, sf_dir):
    """Feature importances from the metric record of a training job, largest first."""
    path = scratch_path(spark, "training")
    train_trees(stored_dataset(spark, sf_dir), f"{path}/trees_metrics.json")
    return evaluation.importance_rows(metric_files.read_metric_records(spark, path))


def ablation(spark, sf_dir):
    return suites.ablation_suite(dataset(spark, sf_dir))


def change_suite(spark, sf_dir):
    return suites.change_suite(features.add_ofi_changes(stored_dataset(spark, sf_dir)))


def cross_suite(spark, sf_dir):
    return suites.cross_suite(pair_frame(spark, sf_dir))


def price_vs_ofi_suite(spark, sf_dir):
    return suites.price_vs_ofi_suite(return_frame(spark, sf_dir))


def metric_json_roundtrip(spark, sf_dir):
    """Metric records through JSON files and back, one row per model and split."""
    scores = evaluation.prediction_metrics(forecasts(spark, sf_dir), ["model", "split"])
    records = evaluation.metric_records(scores, {"bar_seconds": 300})
    path = scratch_path(spark, "records")
    metric_files.write_metric_records(records, f"{path}/forecast_metrics.json")
    stored = metric_files.read_metric_records(spark, path)
    splits = {"train": "train", "val": "validation", "test": "test"}
    rows = None
    for label, name in splits.items():
        part = metric_files.split_scores(stored, name).drop("ord").withColumn("split", F.lit(label))
        rows = part if rows is None else rows.unionByName(part)
    return _comparable(rows)


def suite_records(spark, sf_dir):
    """The forecasts as a suite with free-form parameters, through its JSON document and back."""
    scores = forecast_scores(spark, sf_dir)
    metrics = F.struct("mse", "mae", "correlation", "directional_accuracy", "n_samples")
    result = scores.select(
        F.col("model").alias("experiment"),
        F.lit(TARGET).alias("target"),
        F.array(F.concat(F.lit("forecast:"), F.col("model"))).alias("features"),
        F.col("n_samples").alias("n_test"),
        metrics.alias("metrics"),
        F.create_map(F.lit("weight"), F.lit(1.0)).alias("importance"),
    )
    path = scratch_path(spark, "suites")
    params = {"bar_seconds": 300, "lags": [1, 2, 3], "session": {"open": "09:30", "close": "16:00"}, "seed": None}
    reports.write_suite(result, f"{path}/forecasts.json", "forecasts of the next bar", params)
    read = {"bar_seconds": "int", "lags[1]": "int", "session.close": "string", "seed": "int", "absent": "string"}
    rows = reports.suite_rows(reports.read_documents(spark, f"{path}/forecasts.json"), read)
    return _comparable(rows.withColumns({"features": F.array_join("features", ","), "importance": F.col("importance")["weight"]}))


def comparison_document(spark, sf_dir):
    """The winners from the stored comparison of stored metric records."""
    scores = evaluation.prediction_metrics(forecasts(spark, sf_dir), ["model", "split"])
    path = scratch_path(spark, "comparison")
    metric_files.write_metric_records(evaluation.metric_records(scores), f"{path}/forecast_metrics.json")
    order = F.array_position(F.array(*(F.lit(name) for name in FORECASTS)), F.col("model"))
    records = metric_files.read_metric_records(spark, path).withColumn("ord", F.format_string("%06d", order))
    reports.write_comparison(records, f"{path}/comparison.json")
    return _comparable(reports.comparison_rows(reports.read_documents(spark, f"{path}/comparison.json")))


def report_details(spark, sf_dir):
    """Details of model records whose loss history is the error of each train and validation day."""
    guesses = F.array(*(F.struct(F.lit(m).alias("model"), (F.lit(0.0) if c is None else F.col(c)).alias("p")) for m, c in FORECASTS.items()))
    rows = dataset(spark, sf_dir).filter(F.col("split").isin("train", "val")).select("split", "date", F.col(TARGET).alias("y"), F.inline(guesses))
    error = F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))
    daily = rows.groupBy("model", "split", "date").agg(error.alias("loss")).filter("loss IS NOT NULL")

    def losses(split: str) -> Column:
        listed = F.sort_array(F.collect_list(F.when(F.col("split") == split, F.struct("date", "loss"))))
        return F.transform(listed, lambda day: day["loss"])

    history = daily.groupBy("model").agg(losses("train").alias("train_loss"), losses("val").alias("val_loss"))
    best = F.array_position("val_loss", F.array_min("val_loss")).cast("string")
    records = history.select(
        "model",
        F.lit("2024-02-01T00:00:00").alias("timestamp"),
        F.create_map(F.lit("bar_seconds"), F.lit("300"), F.lit("best_epoch"), best).alias("params"),
        F.struct("train_loss", "val_loss").alias("history"),
    )
    path = scratch_path(spark, "records")
    metric_files.write_metric_records(records, f"{path}/forecast_metrics.json")
    details = evaluation.model_report(metric_files.read_metric_records(spark, path))
    params = F.array_join(F.transform("params", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return _comparable(details.withColumn("params", params), 6)


def bar_files_roundtrip(spark, sf_dir):
    """Bars through the daily sink and the combined sink: how often each row came back from either."""
    path = scratch_path(spark, "bar-files")
    bar_files.write_bar_partitions(bars(spark, sf_dir), f"{path}/daily")
    daily = bar_files.read_bar_partitions(spark, f"{path}/daily")
    bar_files.write_combined(daily, f"{path}/combined")
    combined = bar_files.read_dataset(spark, f"{path}/combined")
    both = daily.withColumn("copy", F.lit("daily")).unionByName(combined.withColumn("copy", F.lit("combined")))
    counts = (F.count_if(F.col("copy") == c).alias(f"n_{c}") for c in ("daily", "combined"))
    return _comparable(both.groupBy(*daily.columns).agg(*counts))


def bar_files_scan(spark, sf_dir):
    """Bar files of three layouts, one per symbol and day, with a combined copy beside them, read back."""
    path = scratch_path(spark, "bar-files")
    stored = stored_bars(spark, sf_dir)
    bucket = F.col("bucket")
    drifted = {
        ("click", "view"): stored,
        ("error", "signup"): stored.withColumns({"bucket": bucket.cast("long"), "date": F.col("date").cast("string")}),
        ("purchase",): stored.withColumn("bucket", bucket.cast("double")).select("bucket", "ofi", "symbol", "date", "n_events", "bar_start", "bar_end"),
    }
    for symbols, rows in drifted.items():
        bar_files.write_bar_files(rows.filter(F.col("symbol").isin(*symbols)), path)
    bar_files.write_combined(stored, f"{path}/ofi5m_combined.parquet")
    return _comparable(bar_files.read_bar_files(spark, path))


def combined_order(spark, sf_dir):
    """Rows out of order in the combined copy."""
    path = scratch_path(spark, "combined")
    bar_files.write_combined(bars(spark, sf_dir), path)
    return bar_files.order_violations(spark, path)


ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    quote_view, quote_scan, daily_tables_scan, ofi_events, ofi_bars, price_bars, price_bars_rn, price_bars_full, bar_returns, return_stats,
    trading_calendar, stored_calendar, partition_discovery, completeness, bar_dedup, bar_time, zscore_daily, zscore_expanding,
    zscore_train, lag_features, bucketed_lags, ofi_changes, describe_ofi, dataset_profile, sequences, pair_bars, pair_returns,
    pair_corr, lead_lag, acf, metrics, rank_ic, best_model, model_report, ar1_ols, ar_p, granger_1lag, granger,
    gbt_eval, forest_scores, forest_eval, forest_importance, importance, ablation, change_suite, cross_suite, price_vs_ofi_suite, metric_json_roundtrip,
    suite_records, comparison_document, report_details,
    bar_files_roundtrip, bar_files_scan, combined_order,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in ALL}
