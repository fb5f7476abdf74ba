"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "a4_lead_features", "a13_churn_features", "a16_value_features", "a17_purchase_summary",
    "m1_roc_auc", "m7_calibration_table", "m10_decile_table", "m12_budget_simulation",
    "m18_value_capture", "d4_policies_by_depth", "d15_priority_list", "v13_order_arithmetic",
    "v17_membership_machine", "c4_segment_funnel", "e7_two_proportions", "l5_person_month_panel",
    "l7_transition_counts", "l19_cohort_retention", "l24_segment_summary", "g2_monthly_kpis",
    "g3_headline", "t11_rolling_backtest", "t15_empirical_intervals", "n4_psi",
    "t9_harmonic_backtest", "l26_integrity_audit", "b11_bgnbd_fit", "e19_permutation_test",
]


def main() -> None:
    from tidemark.plans import load_all
    from tidemark.plans.registry import QUERIES
    from tidemark.session import local_session
    load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus))
    QUERIES["s1_table_scan"](spark, sf_dir).collect()  # start executors and the scan path
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_wall_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
