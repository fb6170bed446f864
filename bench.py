"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.
Every query runs once to warm up and then three times; the median counts. The
tree fit, by far the longest, is timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tickloom.checks.queries import registered

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "ofi_bars", "price_bars", "bar_returns", "zscore_daily", "zscore_expanding", "zscore_train", "lag_features",
    "ofi_changes", "sequences", "lead_lag", "acf", "metrics", "rank_ic", "granger", "ar_p",
)
ONCE = ("gbt_eval",)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, query) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark, known, seconds = session(), registered(), {}
    for name in HEADLINE:
        timed(spark, known[name])
        seconds[name] = round(statistics.median(timed(spark, known[name]) for _ in range(3)), 3)
    for name in ONCE:
        seconds[name] = round(timed(spark, known[name]), 3)
    scale = Path(SF_DIR).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
