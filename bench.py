"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query runs to a noop sink: every row is computed, none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "control_ratio", "plate_effect_correct", "plate_effect_correct_vector", "size_outlier_filter", "trimmed_robust_z",
    "well_median_mad", "treatment_mean_profile", "quantile_normalize", "join_interval_count", "balanced_sample",
    "corr_spearman", "corr_matrix", "angle_graph", "multinom_aic", "bh_adjust", "gsea_running_sum", "ecdf", "dose_auc",
    "effect_distance", "pca_fit_transform", "permutation_test", "drug_vs_control_classifier", "vep_explode", "reconcile_tables", "plate_completeness_stream",
]


def main() -> None:
    from platewise.plans import QUERIES
    from platewise.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "platewise-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
