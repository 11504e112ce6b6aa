"""Time the headline queries; prints one JSON line.

Every query runs whole, into a sink that reads all of its rows; the best of
BENCH_RUNS runs (after one warm-up query) is reported, of slow queries the first run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from traitsieve.plans.catalog import QUERIES

HEADLINE = (
    "separating_features",
    "feature_variance",
    "anova_f_scores",
    "f_test_on_line_items",
    "mutual_information",
    "binned_mutual_information",
    "impute_median",
    "standardise_train_test",
    "preprocess_train_test",
    "quality_report",
    "missing_fraction_gate",
    "narrow_numeric_types",
    "class_distribution_by_split",
    "stratified_split",
    "stratified_folds",
    "pairwise_overlap",
    "auc_on_line_items",
    "class_report",
    "cross_validated_metrics",
    "nearest_neighbours",
    "pca_scores",
    "forest_importance_selection",
    "lasso_selection",
    "logistic_regression_model",
    "rbf_svm_model",
    "gradient_boosting_model",
    "ada_boost_model",
    "model_grid_search",
    "load_csv_table",
)

#: A query that took longer than this is not run again.
AGAIN_BELOW_S = 15


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("traitsieve-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["target_distribution"](spark, folder).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
            spark.catalog.clearCache()
            if best > AGAIN_BELOW_S:
                break
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
