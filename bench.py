"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the ``noop`` sink (the whole plan runs, nothing
is collected to the driver).  Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cv_leaderboard",            # flagship: nested CV model selection over 3 preprocessings
    "cv_ols_single_band",
    "band_target_corr",
    "describe_columns",
    "corr_matrix",
    "impute_median",
    "zero_fill_neighbors",
    "prep_absorbance",
    "prep_snv",
    "prep_sg_deriv1",
    "prep_msc",
    "prep_hull_removal",
    "scale_robust",
    "feat_spectrum_stats",
    "kde_curve",
    "regression_metrics",        # lineitem-sized out-of-fold frame
    "leaderboard_rpd",
    "parse_run_log",
    "loo_metrics",
    "permutation_importance",
    "batch_predict",
    "prep_smoothed_variants",
    "loo_pls",
    "model_rule_committee",
    "model_krr",
    "model_svr",
    "isolation_outliers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PRISMLAKE_MASTER", f"local[{cpus}]")
    from prismlake.session import get_session
    from prismlake.plans.catalog import all_queries
    spark = get_session(f"local[{cpus}]")
    cat = all_queries()
    names = [n for n in HEADLINE if n in cat]
    if len(sys.argv) > 1:
        names = [n for n in names if any(p in n for p in sys.argv[1:])]
    # untimed warm-up: JVM JIT, Python workers, parquet footers
    from prismlake.sources import fixtures as fx
    fx.spectra(spark, sf_dir).write.format("noop").mode("overwrite").save()
    fx.table(spark, sf_dir, "lineitem").selectExpr("sum(l_extendedprice)").collect()
    times = {}
    for name in names:
        t0 = time.time()
        cat[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
