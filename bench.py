"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is built and run to completion into Spark's no-op sink after one warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pharmacy_decision_sla",
    "pharmacy_year_over_year",
    "prescriber_rules",
    "prescriber_fusion",
    "prescriber_verdict",
    "claim_row_errors",
    "claims_issue_report",
    "claims_error_rollup",
    "quarantine_to_anomalies",
    "header_resolution",
    "contract_detection",
    "plan_numeric_profile",
    "auth_category_profile",
    "claims_rules",
    "claims_statistical_outliers",
    "claims_exact_quantiles",
    "claims_signal_merge",
    "claims_evidence",
    "auth_rules",
    "auth_cause_network",
    "plan_isolation_forest",
    "plan_gaussian_scores",
    "price_percentile_rank",
    "anomaly_trend",
    "dataset_sla_risk",
    "document_chunks",
    "diverse_top_chunks",
    "record_explanations",
    "validation_sinks",
    "anomaly_trend_stream",
)


def main() -> None:
    from wardenframe.plans.catalogue import load_catalogue
    from wardenframe.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = load_catalogue()
    names = sys.argv[1:] or HEADLINE
    catalogue["claims_validation_summary"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalogue[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
