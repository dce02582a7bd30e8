"""Times headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3; the median is reported, a first warm-up run of each query is left out).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from granary.plans import catalog  # noqa: E402
from granary.session import local_session  # noqa: E402

HEADLINE = [
    "b3_describe",
    "b12_correlation_matrix",
    "b18_group_quartiles",
    "e1_group_statistics",
    "f4_rolling_fit",
    "f8_rolling_median_ratio",
    "j5_outliers_iqr_clip",
    "j12_target_encoder",
    "j13_out_of_fold_target",
    "k1_standard_scaler",
    "l3_stratified_split",
    "l6_kfold",
    "m1_linear_regression",
    "m9_regularization_path",
    "n5_regression_report",
    "n8_auc_roc",
    "n9_auc_pr",
    "n11_threshold_sweep",
    "o2_cross_val_predict",
    "o3_scaled_cross_validation",
    "o4_grid_search",
    "o6_learning_curve",
    "p5_risk_scoring",
    "q1_feature_psi",
    "q4_score_psi",
    "q13_tumbling_statistics",
    "r6_word_counts",
    "r9_indexed_counts",
    "d6_nearest_neighbors",
    "m14_linear_svm",
    "m15_balanced_svm",
    "m17_random_kernel_features",
    "p8_fill_from_similar",
    "q14_last_n_per_key",
    "r10_text_classifier",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = catalog.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            t0 = time.perf_counter()
            all_queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(taken[1:]), 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
