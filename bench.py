"""Wall time of the headline queries: one warm-up of the session, then one timed run of each.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores. Prints one JSON
line.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from polisframe.plans import QUERIES  # noqa: E402

HEADLINE = [
    "flagship", "path_subfeature", "path_shared_supplier", "positional_step", "sort_multi_valued", "or_across_paths",
    "feature_count_and_extent_active", "geometry_count_by_lod_active", "closure", "lod_filter_and_depth1", "keep_lods_minimum",
    "update_envelopes", "assign_tile",
    "dedupe_objects", "resolve_references", "changes_combined", "change_regions", "s_intersects_diamond",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("path_declared")
    took = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
