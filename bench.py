"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. One query warms the
session up; each query is then timed to a no-op sink, BENCH_RUNS times (median).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINES = [
    "request_cost", "session_cost", "group_by_repo", "group_by_model", "project_model_filter", "repo_rollup", "cost_outliers", "friction_by_repo",
    "active_model", "near_duplicate_messages",
]


def run(spark, build, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from tokentally.plans import registry
    from tokentally.runtime import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load()
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    times = {}
    run(spark, registry.QUERIES[names[0]], sf_dir)
    for name in names:
        build = registry.QUERIES[name]
        times[name] = round(statistics.median(run(spark, build, sf_dir) for _ in range(int(os.environ.get("BENCH_RUNS", "1")))), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
