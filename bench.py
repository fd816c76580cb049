"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up, then three timed runs; the median is
reported.  A run executes the whole plan into Spark's ``noop`` sink (no
rows are pulled into the driver) and cached data is dropped before every
run, so a timing includes the scans and joins behind the query.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortcraft.plans.registry import all_queries  # noqa: E402
from cohortcraft.session import build_session  # noqa: E402

HEADLINE = [
    "retention_summary",
    "customer_transitions",
    "new_customers_anti",
    "loyalty_distribution",
    "revenue_rollup",
    "describe_numeric",
    "box_stats",
    "density_curve",
    "missing_report",
    "describe_text",
    "top_categories",
    "correlation_matrix",
    "loan_prepared",
    "ridge_cv",
    "learning_curve_all",
]


def run_once(spark, fn, sf_dir: str) -> float:
    spark.catalog.clearCache()
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = build_session(f"local[{cpus}]", app="cohortcraft-bench", shuffle_partitions=2 * cpus)
    qs = all_queries()
    times: dict[str, float | None] = {}
    failed: list[str] = []
    for key in only or HEADLINE:
        fn = qs[key]
        try:
            run_once(spark, fn, sf_dir)
            times[key] = round(statistics.median(run_once(spark, fn, sf_dir) for _ in range(reps)), 3)
        except Exception as e:  # noqa: BLE001  (report the key, keep measuring the rest)
            times[key] = None
            failed.append(key)
            print(f"{key} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    sf = os.path.basename(sf_dir).replace("sf", "")
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "failed": failed, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
