"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` how
often a query is timed (the median counts) after one run to warm up, and
``BENCH_QUERIES`` a choice of queries, ``all`` for every registered one.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import QUERIES  # noqa: E402
from tidemark.session import create_session  # noqa: E402

HEADLINE = (
    "rider_features_daily",
    "rider_rates",
    "driver_features_daily",
    "driver_hours_online",
    "trip_features",
    "pit_join_single",
    "pit_join_service",
    "online_lookup",
    "materialize_slice",
    "dq_report",
    "profile_stats",
    "drift_ks",
    "drift_psi",
    "drift_report",
    "prediction_drift",
    "health_windows",
    "canary_health",
    "eval_metrics",
    "approval_state",
    "stage_state",
    "compliance_gdpr",
    "stream_rider_counts",
    "stream_dead_letter",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else list(HEADLINE))
    spark = create_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run > 0 or runs == 0:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
