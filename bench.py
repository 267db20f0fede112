"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_RUNS    timed runs per query after one warm-up (default 3, the median counts)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from faretide.registry import load
from faretide.session import build_session

HEADLINE = [
    "w01_consecutive_changes",
    "w01_tied_times",
    "w02_run_segmentation",
    "j04_run_changes",
    "a13_topn_index",
    "j05_topn_diff",
    "a14_trend_index",
    "w04_window_changes",
    "j12_item_table",
    "a02_describe_prices",
    "a05_daily_distribution",
    "a07_cheapest_row",
    "a12_watchlist",
    "a20_item_stats",
    "a21_kpi_rollup",
    "j01_missing_in_base",
    "j02_cheaper_alternatives",
    "j07_cheaper_same_trip",
    "j08_new_alerts",
    "p08_normalize_dates",
    "p27_parse_offers",
    "s12_price_series",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(cores),
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("OFF")
    found, times = load(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            # Building counts as well: it may look at the data to choose a plan.
            found[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken[1:]), 4)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
