"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("daily_model_usage", "weekly_usage", "session_usage", "project_usage", "blocks_5h", "dedup_best_candidate", "order_line_dedup", "cumulative_delta", "top_models", "monthly_budget", "multi_range_batch", "residual_attribution")


def logs(spark) -> dict[str, float]:
    """Four reports over logs that tallyforge.logs writes: one run to warm up, then the median of five."""
    from statistics import median

    from tallyforge import api
    from tallyforge.logs import counter_log, streamed_log
    from tallyforge.plans.ledger import price_table
    from tallyforge.staging import fresh_path

    roots = {"claude": streamed_log(spark, fresh_path(spark, "bench-streamed")), "codex": counter_log(spark, fresh_path(spark, "bench-counters"))}
    out = {}
    for source, root in roots.items():
        for kind in ("daily", "session"):
            times = []
            for _ in range(6):
                began = time.perf_counter()
                api.usage_report(spark, kind, source, root, price_table(spark)).rolled().write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - began)
            out[f"{source}_{kind}"] = round(median(times[1:]), 3)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyforge import registry

    found, took = registry.queries(), {}
    run = lambda name: found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # warms up the JVM and the file cache
    for name in HEADLINE:
        times = []
        for _ in range(2):
            began = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    if os.environ.get("BENCH_LOGS"):
        took |= logs(spark)
    print(json.dumps({"metric": "ledger_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
