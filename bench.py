"""Headline-query benchmark: prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built lazily from the registry and fully executed (collect of its
small result); the time includes planning and every job the query needs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelcast.plans import queries as Q  # noqa: E402
from panelcast.session import get_session  # noqa: E402

HEADLINE = [
    "c1_master_panel",                  # panel build: 3 fact aggregations + 4 joins
    "c2_feature_table",                 # one Window node for all lags / rolling moments
    "c4_baseline_metrics_main",         # split + baselines + train-only threshold + all metrics
    "c5_suite_baseline_metrics",        # four specifications over one feature table
    "speed_supplier_baseline_metrics",  # supplier x month panel (largest panel)
    "m4_m5_linear_metrics",             # OLS + ridge, 5 expanding folds from one Gram scan
    "speed_supplier_linear_metrics",    # the same on the supplier panel
    "a10_damage_histogram",
    "w8_fold_rows",
    "m6_m7_all_model_metrics",          # forest and boosting
    "m11_permutation_importance",       # 30 permutations of the test rows, all features
]
REPEATS = 3                             # the median of so many runs counts


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", cpus)
    # JVM warm-up (class loading, first codegen) outside the timed queries
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        fn = Q.REGISTRY[name][0]
        took = []
        for _ in range(REPEATS):
            t0 = time.perf_counter()
            out = fn(spark, sf_dir).collect()
            took.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(took), 3)
        rows[name] = len(out)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
