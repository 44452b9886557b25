"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tardy.plans.registry import QUERIES  # noqa: E402
from tardy.sources.fixtures import warehouse_tables  # noqa: E402
from tardy.session import local_session  # noqa: E402

HEADLINE = ("submissions", "student_course_lvl", "grid_coeffs", "course_density_matrix")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="tardy-bench")
    # JVM / Parquet reader warm-up, not timed
    spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("count(*)").collect()
    times = {}
    t0 = time.time()
    warehouse_tables(spark, sf_dir)  # derive the nine LMS tables from the driver tables
    times["fixture_warehouse"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()  # every column is computed
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
    }))


if __name__ == "__main__":
    main()
