"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed runs per
query (the median counts).  Building a query is part of its time, since fitted operators run small
profile jobs while they are built.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tallyloom.catalog import QUERIES

HEADLINE = [
    "q_scan_pruned", "q_left_join_keep", "q_group_agg_encode", "q_group_nunique", "q_stats_by_area", "q_group_median_fill_src",
    "q_freq_encode", "q_crosstab_encode", "q_shift_rolling", "q_ecdf_in_band", "q_row_number", "q_topk_lines", "q_dedupe_first",
    "q_target_mean_oof", "q_label_encode", "q_uniqueness_pattern", "q_stratified_kfold", "q_iqr_filter", "q_m_auc", "q_m_norm_gini",
    "q_topk_ensemble", "q_stats_pack", "q_mean_std_encode", "q_nearest_join", "q_link_edges", "job_entity_features", "job_demand_grid", "job_access_counts", "job_group_stats",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().collect()  # start the engine
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
