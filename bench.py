"""Wall-clock times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line.

Every query is run once to warm up and then RUNS times; the median counts. The result is written
nowhere: Spark's noop sink takes all rows.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from duochron import queries

RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = ["latest", "latest_n", "range_closed", "entity_snapshot", "as_of", "audit_history", "window_scan_visible", "pit_shared_cutoff", "pit_label_cutoff", "pit_few_cutoffs", "pit_row_cutoff", "rolling_mean", "rolling_row_cutoff", "dedupe_write_id", "validate_batch", "retention_last_k"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every, took, spread = queries.queries(), {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            every[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
        spread[name] = [round(min(times[1:]), 3), round(max(times[1:]), 3)]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "spread": spread, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
