"""Headline queries on one table directory; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "marginal", "all_marginals", "conditional_rollups", "contingency", "label_encode", "quantile_bin",
    "cmi_plain", "cmi_items", "cmi_by_segment", "chi2_composite", "rank_ci_sets", "permutation_test",
    "tvd", "kl", "mmd_rbf", "wasserstein_1d", "workload_error",
    "gaussian_measure", "stratified_kfold", "weighted_sample", "permute_within_strata",
    "rod", "auc_weighted_ovr", "pairwise_fairness", "knn_consistency",
    "pair_scores", "fit_tree", "query_unmeasured_marginal", "ci_projection", "apply_repair_plan",
    "mst_synthesize", "run_grid",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    from pyspark.sql import SparkSession

    from catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("margrid-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    run("marginal")  # start-up of the engine is not part of any query
    times = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
