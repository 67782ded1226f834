"""Times the headline queries once warm and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from quillon.plans import catalogue  # noqa: E402

HEADLINE = ["flagship", "full_scan", "by_key", "index_prefix", "scalar_projection", "select_distinct", "global_aggregates", "aggregate_distinct", "group_many", "group_having", "group_top_k", "group_top_k_having", "order_limit_offset", "order_expression", "global_window_input", "functions_text", "live_pages", "fluent_grouped", "mutations"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    made, times = catalogue.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(sorted(runs[1:])[0], 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
