"""Times the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sharegate.plans.queries import queries

HEADLINE = [
    "content_exclusions_by_rule", "decision_map", "pii_by_lang", "pii_gate", "redacted_documents", "manifest_header",
    "content_hash_by_source", "ignore_decisions", "verify_objects", "triage_top_paths", "shard_assignment",
    "retention_plan", "quick_scan_verdict", "structural_paths", "ledger_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("sharegate-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             # several tasks per core also for one small file
             .config("spark.sql.files.maxPartitionBytes", "1m").config("spark.sql.files.openCostInBytes", "64k")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    cold, warm, all_queries = {}, {}, queries()
    for name in HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "million_chars_per_sec": {n: round(chars / 1e6 / warm[n], 2) for n in
                                  ("content_exclusions_by_rule", "pii_by_lang", "redacted_documents", "quick_scan_verdict")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
