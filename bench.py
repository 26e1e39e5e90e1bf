"""Headline queries, timed: one warm-up, median of three. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from linkspark.config import AggregationParams  # noqa: E402
from linkspark.plans import aggregation  # noqa: E402
from linkspark.workload import files  # noqa: E402
from linkspark.workload.catalog import QUERIES  # noqa: E402
from linkspark.workload.views import Views  # noqa: E402

HEADLINE = [
    "hourly_agg_large", "weekly_profile_large", "hourly_agg", "weekly_profile", "link_report", "best_valid",
    "failed_obs", "missing_obs", "hausdorff", "validate_obs", "aggregation_run", "quantiles",
]
REPEATS = 3


def aggregation_plan(spark: SparkSession, sf_dir: str) -> float:
    """Seconds of a whole run from CSV to all outputs, the second of two."""
    folder = tempfile.mkdtemp(prefix="linkspark-bench-")
    files._raw(Views(spark, sf_dir)).write.option("header", True).csv(f"{folder}/raw")
    took = 0.0
    for attempt in range(2):
        start = time.perf_counter()
        aggregation.run(spark, f"{folder}/raw", f"{folder}/out{attempt}", AggregationParams())
        took = time.perf_counter() - start
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        runs = []
        for attempt in range(REPEATS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 3)
    timings["aggregation_plan_csv"] = round(aggregation_plan(spark, sf_dir), 3)
    rows = {
        "observations": spark.read.parquet(f"{sf_dir}/events.parquet").count(),
        "large_observations": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(),
    }
    # hourly and weekly rollup of the large table together, as one run does them
    both = timings["weekly_profile_large"]
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "rows": rows,
                "rollup_rows_per_sec": round(rows["large_observations"] / both),
                "csv_run_rows_per_sec": round(rows["observations"] / timings["aggregation_plan_csv"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
