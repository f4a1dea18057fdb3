"""Time the headline queries: one JSON line with the total and the median of each query's runs, in seconds.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: cores (default 8). BENCH_REPEATS: timed runs after
one warm-up (default 5).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sparrowset.plans.bindings import QUERIES
from sparrowset.session import SETTINGS

HEADLINE = (
    "q1_topk_in",
    "q2_recurrence",
    "q3_first_before_last",
    "q4_dup_pairs",
    "q5_spread",
    "q6_exists_count",
    "q7_masked_sum",
    "q8_histogram",
    "join_multi",
    "sort_multi",
    "ring_less_u",
    "ring_mul",
    "ring_mux",
    "share_a2b",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus, repeats = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPEATS", "5"))
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS)
    spark = builder.config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took, spread = {}, {}
    for name in HEADLINE:
        run(name)
        runs = [run(name) for _ in range(repeats)]
        took[name], spread[name] = round(statistics.median(runs), 4), round(max(runs) - min(runs), 4)
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "spread": spread, "repeats": repeats, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
