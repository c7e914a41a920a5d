"""Seconds per headline query, warm, as one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8), BENCH_RUNS
the timed runs per query (default 3; the median counts). Every run builds the query anew, including checks
and intermediate tables, and evaluates all columns of all rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from trainlake.plans.catalog import QUERIES
from trainlake.session import build_session

HEADLINE = [
    "daily_metrics", "daily_metrics_split", "newest_metrics", "session_summary", "weekly_summary", "week_over_week",
    "week_calendar", "personal_best", "session_history", "workout_normalise", "interval_flatten", "incremental_filter",
    "upsert_sessions", "recovery_extract", "recovery_vs_performance", "recovery_bands", "context_block",
    "tip_session_lookup", "entity_scores", "policy_decisions", "context_budget", "context_request",
    "quarantine_retention", "recalibrate_batch", "recalibrate_fold", "recalibrate_fold_split", "plan_days",
    "coaching_prompt", "weekly_prompt", "notification_payload", "raw_json_scan", "stream_sessions", "stream_metrics",
    "stream_confidence",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "trainlake-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)  # warm-up
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    result = {
        "metric": "total warm seconds of the headline queries (median per query)",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": scale,
        "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
