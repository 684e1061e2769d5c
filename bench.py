"""Headline queries on BENCH_SF_DIR with local[BENCH_CPUS]: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "clean_readings_full", "audit_household_quality", "audit_consumption", "cohort_halfhour_load",
    "cohort_step_profile", "feature_table", "feature_row_lags", "scalar_tertiles", "model_ridge_two_features",
    "point_metrics_by_supplier", "conformal_quantile_large_groups", "conformal_static", "conformal_rolling",
    "conformal_aci", "conformal_shift_aware", "shift_two_sample", "shift_two_sample_large_groups",
    "backtest_method_table", "interval_metrics_by_supplier", "interval_daily_sums", "conditional_reliability",
    "bootstrap_suppliers", "bootstrap_comparison", "ablation_gamma_rates", "ablation_window_lengths",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loadshape-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from catalog.queries import QUERIES

    seconds = {}
    for name in HEADLINES:
        took = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            # computes every row and column without bringing them to the driver
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds, median per query",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
