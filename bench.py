"""Times the headline queries on one machine and prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from skein.plans import catalogue

HEADLINE = ["graph_edges", "edge_dedup", "rubric_score", "neighbors_filtered", "top_edges_per_node", "information_content", "pair_scores", "coverage_report", "bfs_depth2", "k_paths", "search_lexical", "resolve_embedding", "quote_verification", "events_windows"]


def main() -> None:
    cpus, data = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            catalogue.queries()[name](spark, data).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total of median query times", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(data.rstrip("/"))}))


if __name__ == "__main__":
    main()
