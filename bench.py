"""Time registered queries; prints one JSON line.

Every query runs once untimed, so that compilation is not measured, and once
timed, from building the plan to the last row.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` an optional comma-separated choice of names.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stayrate.plans.catalog import QUERIES
from stayrate.session import local_session

HEADLINE = (
    "churn_by_contract",
    "churn_kpis",
    "clean_accounts",
    "derive_features",
    "cap_outliers",
    "dq_null_counts",
    "dq_service_domain",
    "valid_rows",
    "churn_by_service",
    "service_impact",
    "survival_curve",
    "histogram_by_class",
    "kde",
    "box_stats",
    "describe_columns",
    "correlation_matrix",
    "t_test",
    "chi_square",
    "ingest_accounts",
    "update_accounts",
    "delete_accounts",
    "latest_prediction",
    "assemble",
    "stratified_split",
    "stratified_folds",
    "oversample_random",
    "score_batch",
    "explain_batch",
    "score_stored",
    "classification_report",
    "roc_auc",
    "roc_curve",
    "pr_curve",
    "price_sensitivity",
    "scenario_comparison",
    "revenue_impact",
    "segment_impact",
    "column_profile",
    "shift_column",
    "smote",
    "train_logistic",
    "train_random_forest",
    "train_gradient_boosting",
    "stream_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "stayrate-bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = run(name)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
