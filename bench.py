"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "centroid", "pca_aligned", "grid_gradients", "ms_bandwidth", "features_training", "features_extractor",
    "radius_pairs", "nearest_site_pbc", "nearest_site_open", "ws_summary", "ws_vacancies",
    "surface_atoms", "train_test_split", "impute_median", "regression_metrics", "dump_scan",
]


def main() -> None:
    from checks.fixtures import cloud_lineitem, dump_text
    from checks.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - started, 3)

    names = sys.argv[1:] or HEADLINE
    # inputs made from the tables once per session: the point cloud and its dump files
    timed("ingest_points", lambda: cloud_lineitem(spark, sf_dir))
    if "dump_scan" in names:
        timed("write_dumps", lambda: dump_text(spark, sf_dir))
    for name in names:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
