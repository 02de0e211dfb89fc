"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeframe import queries  # noqa: E402
from gaugeframe.session import session  # noqa: E402

HEADLINE = [
    "profile", "weighted_merge", "equal_support", "range_join", "density_2d", "quadrants", "group_means", "feature_filter", "feature_correlations", "rollup4", "nested_median",
    "robust_sigma", "nearest_time", "knn_vote", "rolling_median", "gradient", "half_max", "longest_run", "align_grid", "split_scan", "welch", "anova", "rank_sum", "bh",
    "reciprocal_best", "skyline", "outliers", "tumbling", "session_runs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("profile", "gradient"):  # start-up isn't what is measured
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
