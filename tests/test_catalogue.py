"""A few queries of every module against their SQL at the smallest scale, and the contract's shape."""

import importlib.util
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, rows_of

DIR = "/root/testdata/sf0.001"
SAMPLE = (
    "pharmacy_decision_sla", "contract_detection", "claim_row_errors", "claims_error_rollup", "ordinal_encoding", "plan_numeric_profile", "claims_rules",
    "claims_statistical_outliers", "claims_exact_quantiles", "claims_evidence", "claims_explanations", "prescriber_verdict", "prescriber_root_causes", "auth_rules",
    "auth_cause_network", "price_percentile_rank", "overall_sla_risk", "label_roc_auc", "plan_service_risk", "resolution_procedures", "record_explanations",
    "validation_sinks", "anomaly_session_stream",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def test_names_and_coverage():
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries)
    training_data = [n for n in queries if re.match(r"op\d+_", n) or "pipeline" in n]
    if importlib.util.find_spec("wardenframe.llm") is None:
        assert not training_data
    else:
        assert sorted(n.split("_")[0] for n in training_data) == sorted([*(f"op{k}" for k in range(1, 14)), "pipeline"])


def test_entry_runs(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, DIR)
    result = sql.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, result.fetchall())


@pytest.mark.parametrize(("final", "parts"), [("final_anomaly", ("bayesian_anomaly", "rule_anomaly"))])
def test_final_flag_covers_every_signal(spark, final, parts):
    df = contract.queries()["claims_signal_merge"](spark, DIR)
    assert df.where(" OR ".join(f"{final} < {p}" for p in parts)).count() == 0
    assert df.count() == df.select("plan_id", "issuer_id").distinct().count()
