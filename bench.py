"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from checks.queries import queries

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINES = (
    "replay_watermark",
    "emissions_sw",
    "emissions_dww",
    "emissions_alw",
    "emissions_cbw",
    "output_counts_alw",
    "output_counts_cbw",
    "faulty_windows_cbw",
    "lateness_overall",
    "lateness_days_per_meter",
    "latency_summary",
    "nearest_pairs",
    "stage_summary",
    "smoothed_cpu",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog, times = queries(), {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS + 1):
            started = time.time()
            catalog[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": FOLDER.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
