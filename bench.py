"""Times the headline joins, each built anew for every run; prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from manyfold.queries import QUERIES

HEADLINE = (
    "chain", "star", "cycle4", "cycle4_mixed", "cycle4_one_round", "cycle4_leapfrog", "triangle", "triangle_mixed", "triangle_one_round",
    "cycle_tails", "cycle_tails_mixed", "cycle4_order_limit", "cycle4_with", "residual", "composite", "self_join", "join_full", "join_semi", "join_null_safe",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        spark.catalog.clearCache()  # derived relations that a planner cached for an earlier run
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in HEADLINE:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline joins", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
