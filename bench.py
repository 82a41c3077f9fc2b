"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from variloom.plans.all import QUERIES

HEADLINE = (
    "interval_merge", "interval_overlap_join", "interval_annotate", "interval_intersect", "filter_include_regions", "filter_density_window", "filter_remove_overlapping",
    "window_cluster_count", "variant_statistics", "derived_annotations", "merge_records", "compare_positions", "roc_curve", "sv_match_breakends", "cnv_greedy_match",
    "mendelian_status", "genotype_proportions", "residue_statistics",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", cpus).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        times = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)  # the first run warms up
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
