"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from factloom import catalog

HEADLINE = [
    "flagship_large_customers_reopened", "a5_verdict_summary", "a9_findings_of_failures", "a7_coverage_percentage", "b8_co_change_pairs", "c1_row_number", "c10_flap_detection", "c12_grouped_sums",
    "d1_opener_concentration", "d2_sentence_length_uniformity", "d12_repeated_literals", "e1_coupling", "e6_clone_windows", "e9_churn", "g2_resolved_names", "n1_normalized_records",
]


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["a10_numeric_interval"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compile once
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
