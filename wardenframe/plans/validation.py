"""Row validation, issue reports and integrity checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag
from wardenframe.operators import validation as va
from wardenframe.operators.contracts import CLAIMS
from wardenframe.plans import views
from wardenframe.plans.registry import query
from wardenframe.session import materialise
from wardenframe.sources.tables import read_table

# The claims contract cut down to the columns the test view has.
CONTRACT = replace(CLAIMS, required=views.CLAIMS_COLUMNS)

_NUM = "CASE WHEN regexp_matches(trim(claim_amount), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(claim_amount) AS DOUBLE) END"
_DATE = "CASE WHEN regexp_matches(claim_date, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN try_strptime(claim_date, '%Y-%m-%d') END"
_BLANK = {c: f"({c} IS NULL OR trim({c}) = '')" for c in views.CLAIMS_COLUMNS}
# Name, predicate, type, column, message of every check, in check order.
_CHECKS = [
    *[(f"e_blank_{c}", _BLANK[c], "completeness", c, "Missing/blank values") for c in ("claim_id", "member_id", "provider_id")],
    ("e_blank_claim_date", _BLANK["claim_date"], "completeness", "claim_date", "Missing/blank values"),
    ("e_type_claim_date", f"(({_DATE}) IS NULL AND NOT {_BLANK['claim_date']})", "type", "claim_date", "Invalid date value"),
    ("e_blank_claim_amount", _BLANK["claim_amount"], "completeness", "claim_amount", "Missing/blank values"),
    ("e_type_claim_amount", f"(({_NUM}) IS NULL AND NOT {_BLANK['claim_amount']})", "type", "claim_amount", "Invalid float value"),
    ("e_blank_claim_status", _BLANK["claim_status"], "completeness", "claim_status", "Missing/blank values"),
    ("e_denial", f"(claim_status IN ('DENIED') AND {_BLANK['denial_code']})", "completeness", "denial_code",
     "Missing/blank value required when claim_status in ['DENIED']"),
    ("e_domain", "(claim_status IS NOT NULL AND claim_status NOT IN ('PAID', 'PENDING', 'DENIED'))", "domain", "claim_status",
     "Allowed values: ['PAID', 'PENDING', 'DENIED']"),
    ("e_range", f"coalesce(({_NUM}) < 0, false)", "range", "claim_amount", "Negative value not allowed"),
    ("e_copy", "(claim_id IS NOT NULL AND count(*) OVER (PARTITION BY claim_id) > 1)", "duplicate", "claim_id", "Duplicate value"),
]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TAGGED_SQL = (
    views.with_views("claims_raw") + ",\ntagged AS (SELECT *, (" + " OR ".join(n for n, *_ in _CHECKS) + ") AS bad FROM (SELECT *, "
    + ", ".join(f"{p} AS {n}" for n, p, *_ in _CHECKS) + " FROM claims_raw) t)"
)
_ISSUES = " UNION ALL ".join(
    f"SELECT {_quote(k)} AS type, 'ERROR' AS severity, {_quote(c)} AS \"column\", {_quote(m)} AS message, provider_id FROM tagged WHERE {n}" for n, _, k, c, m in _CHECKS
)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.tag_errors(views.claims_raw(spark, sf_dir), CONTRACT)


@query(
    "claim_row_errors", "C1 C2 C3 C4 C5 C6",
    TAGGED_SQL + " SELECT claim_id, member_id, provider_id, concat_ws(';', " + ", ".join(f"CASE WHEN {n} THEN '{k}:{c}' END" for n, _, k, c, _ in _CHECKS) + ") AS errors FROM tagged",
)
def claim_row_errors(spark, sf_dir):
    text = F.concat_ws(";", F.transform("errors", lambda e: F.concat(e["type"], F.lit(":"), e["column"])))
    return tagged(spark, sf_dir).select("claim_id", "member_id", "provider_id", text.alias("errors"))


_COLUMNS = ", ".join(views.CLAIMS_COLUMNS)


@query("claims_valid_rows", "C7", TAGGED_SQL + f" SELECT {_COLUMNS} FROM tagged WHERE NOT bad")
def claims_valid_rows(spark, sf_dir):
    return va.split(tagged(spark, sf_dir))[0]


@query("claims_quarantined_rows", "C7", TAGGED_SQL + f" SELECT {_COLUMNS} FROM tagged WHERE bad")
def claims_quarantined_rows(spark, sf_dir):
    return va.split(tagged(spark, sf_dir))[1].drop("errors")


@query(
    "claims_issue_report", "C8",
    TAGGED_SQL + f', issues AS ({_ISSUES}) SELECT type, severity, "column", message, count(*) AS rows FROM issues GROUP BY ALL',
)
def claims_issue_report(spark, sf_dir):
    return va.issue_report(tagged(spark, sf_dir), CONTRACT)


@query(
    "claims_issue_report_with_header", "C8 B7",
    TAGGED_SQL + f', issues AS ({_ISSUES}) SELECT type, severity, "column", message, count(*) AS rows FROM issues GROUP BY ALL UNION ALL '
    + " UNION ALL ".join(f"SELECT 'schema', 'ERROR', '{c}', 'Missing required column', NULL" for c in CLAIMS.required if c not in views.CLAIMS_COLUMNS)
    + " UNION ALL SELECT 'schema', 'WARNING', 'batch', 'Unexpected column', NULL",
)
def claims_issue_report_with_header(spark, sf_dir):
    """The full contract: columns the view lacks are errors, a column it does not know is a warning."""
    df = views.claims_raw(spark, sf_dir).withColumn("batch", F.lit("b1"))
    return va.issue_report(va.tag_errors(df, CLAIMS), CLAIMS)


@query(
    "claims_validation_summary", "C7 C8",
    TAGGED_SQL + " SELECT count(*) AS total_records, count(*) FILTER (NOT bad) AS valid_records, count(*) FILTER (bad) AS invalid_records, CASE WHEN count(*) FILTER (bad) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM tagged",
)
def claims_validation_summary(spark, sf_dir):
    return va.summary(tagged(spark, sf_dir))


@query(
    "claims_error_rollup", "C9",
    TAGGED_SQL + f", issues AS ({_ISSUES}) SELECT CASE WHEN grouping(type) = 0 THEN 'file_type' WHEN grouping(provider_id) = 0 THEN 'file' ELSE 'run' END AS level, "
    "provider_id AS file, type, count(*) AS errors FROM issues GROUP BY ROLLUP (provider_id, type)",
)
def claims_error_rollup(spark, sf_dir):
    """Each provider's rows stand for one landed file."""
    return va.error_rollup(tagged(spark, sf_dir), "provider_id")


@query(
    "claims_run_summary", "C9 A9",
    TAGGED_SQL + ", f AS (SELECT provider_id, count(*) AS rows, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS invalid FROM tagged GROUP BY provider_id) "
    "SELECT count(*) AS files_processed, count(*) FILTER (invalid > 0) AS files_failed, CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(valid) AS BIGINT) AS total_valid_rows, "
    "CAST(sum(invalid) AS BIGINT) AS total_invalid_rows, CASE WHEN count(*) FILTER (invalid > 0) > 0 THEN 'issues_found' ELSE 'pass' END AS overall_status FROM f",
)
def claims_run_summary(spark, sf_dir):
    return va.run_summary(tagged(spark, sf_dir), "provider_id")


_AUTH_COLUMNS = (
    "authorization_id", "patient_id", "provider_id", "request_date", "approval_date", "valid_from_date", "valid_to_date",
    "authorization_type", "service_code", "requested_quantity", "charged_amount", "approval_status",
)


@query(
    "auth_null_findings", "C10 E2",
    views.with_views("auth_records") + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 4) AS null_percent FROM auth_records" for c in _AUTH_COLUMNS
    ),
)
def auth_null_findings(spark, sf_dir):
    return va.null_findings(views.auth_records(spark, sf_dir), _AUTH_COLUMNS)


_SIGNED = ("tot_clms", "tot_30day_fills", "tot_day_suply", "tot_drug_cst", "tot_benes", "ge65_tot_clms")


@query(
    "prescriber_negative_values", "C11",
    views.with_views("prescriber_records") + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < 0) AS negative_count FROM prescriber_records" for c in _SIGNED
    ),
)
def prescriber_negative_values(spark, sf_dir):
    return va.negative_findings(views.prescriber_records(spark, sf_dir), _SIGNED)


@query(
    "line_duplicate_profile", "C12",
    "WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) "
    "SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS surplus_rows, "
    "round(coalesce(sum(n) FILTER (n > 1), 0) * 100.0 / sum(n), 4) AS duplicate_percentage FROM g",
)
def line_duplicate_profile(spark, sf_dir):
    return va.duplicate_rows(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))


@query(
    "line_duplicate_flags", "C12 I1",
    "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_copy FROM lineitem",
)
def line_duplicate_flags(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return va.mark_copies(lines, ["l_orderkey", "l_linenumber"], "is_copy")


@query("line_rows_deduplicated", "C12 J8", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def line_rows_deduplicated(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").dropDuplicates()


@query(
    "duplicate_key_examples", "C13",
    "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1), t AS (SELECT count(*) AS repeated_keys, CAST(sum(copies) AS BIGINT) AS repeated_rows FROM g) "
    "SELECT l_orderkey, l_linenumber, copies, repeated_keys, repeated_rows FROM g, t ORDER BY copies DESC, l_orderkey, l_linenumber LIMIT 10",
)
def duplicate_key_examples(spark, sf_dir):
    return va.duplicate_keys(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "key_set_comparison", "C14 G9",
    "WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT DISTINCT o_orderkey AS k FROM orders) "
    "SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS in_both, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL OUTER JOIN b ON a.k = b.k",
)
def key_set_comparison(spark, sf_dir):
    left = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    right = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return va.compare_keys(left, right, ["k"])


@query(
    "auth_output_conformance", "C17",
    views.with_views("anomalies") + ", r AS (SELECT signal_count > 0 AS anomaly, CASE WHEN signal_count > 0 OR score > 300 THEN severity ELSE 'NORMAL' END AS severity, signal_count FROM anomalies) "
    "SELECT count(*) AS records, count(*) FILTER (NOT anomaly AND severity <> 'NORMAL') AS normal_with_severity, "
    "count(*) FILTER (anomaly AND severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')) AS anomaly_without_severity, count(*) FILTER (NOT anomaly AND signal_count <> 0) AS normal_with_signals FROM r",
)
def auth_output_conformance(spark, sf_dir):
    rows = views.anomalies(spark, sf_dir).select(
        (F.col("signal_count") > 0).alias("anomaly"),
        F.when((F.col("signal_count") > 0) | (F.col("score") > 300), F.col("severity")).otherwise("NORMAL").alias("severity"),
        "signal_count",
    )
    return va.output_conformance(rows, "anomaly", "severity", "signal_count")


@query(
    "quarantine_to_anomalies", "C19",
    TAGGED_SQL + ", has AS (SELECT " + ", ".join(f"bool_or({n}) AS {n}" for n, *_ in _CHECKS) + " FROM tagged) "
    "SELECT 'CLAIMS' AS source_dataset, claim_id AS record_id, 'MISSING_FIELD' AS anomaly_type, 'HIGH' AS severity, 'OPEN' AS status, f AS affected_field, "
    "CASE f WHEN 'multiple_fields' THEN 'Validation rule failed' WHEN 'member_id' THEN 'Missing/blank values' WHEN 'denial_code' THEN 'Missing/blank value required when claim_status in [''DENIED'']' END AS error_message, "
    "'Data quality issue in source file.' AS likely_cause, 'Correct the field in the source system and re-upload.' AS recommended_fix FROM ("
    "SELECT t.claim_id, CASE WHEN trim(member_id) = '' AND has.e_blank_member_id THEN 'member_id' WHEN trim(denial_code) = '' AND has.e_denial THEN 'denial_code' ELSE 'multiple_fields' END AS f FROM tagged t, has WHERE bad) z",
)
def quarantine_to_anomalies(spark, sf_dir):
    rows = materialise(tagged(spark, sf_dir), "claims-tagged")  # read for the issues found and for the rows
    return va.anomaly_rows(rows, CONTRACT, "claim_id", "CLAIMS")


# Anomaly records as JSON text, some of them malformed on purpose.
_RECORD_SQL = (
    "CASE event_id % 11 "
    "WHEN 1 THEN concat('{\"dataset_type\":\"claims\",\"record_id\":\"', user_id, '\"}') "
    "WHEN 2 THEN concat('{\"dataset_type\":\"labs\",\"record_id\":\"', user_id, '\",\"detection_summary\":{\"final_anomaly\":true,\"final_severity\":\"HIGH\",\"final_risk_score\":1,\"rule_anomaly\":true,\"ml_anomaly\":false},\"rule_based_evidence\":[],\"ml_based_evidence\":null,\"record_context\":{}}') "
    "WHEN 3 THEN concat('{\"dataset_type\":\"pharmacy\",\"record_id\":\" \",\"detection_summary\":{\"final_anomaly\":true},\"rule_based_evidence\":{},\"ml_based_evidence\":[],\"record_context\":{\"u\":', user_id, '}}') "
    "WHEN 4 THEN concat('{\"dataset_type\":\"pharmacy\",\"record_id\":\"', user_id, '\",\"detection_summary\":\"none\",\"rule_based_evidence\":[],\"ml_based_evidence\":{},\"record_context\":[1],\"sla\":\"late\"}') "
    "WHEN 5 THEN concat('not json ', user_id) "
    "ELSE concat('{\"dataset_type\":\"authorization\",\"record_id\":\"', user_id, '\",\"detection_summary\":{\"final_anomaly\":true,\"final_severity\":\"HIGH\",\"final_risk_score\":1,\"rule_anomaly\":true,\"ml_anomaly\":false},\"rule_based_evidence\":[{\"rule_name\":\"R\"}],\"ml_based_evidence\":{},\"record_context\":{},\"sla\":null}') END"
)
_EXPECTED = {
    1: ["missing required field 'detection_summary'", "missing required field 'ml_based_evidence'", "missing required field 'record_context'", "missing required field 'rule_based_evidence'"],
    2: ["unsupported dataset_type 'labs'"],
    3: ["record_id must be a non-empty string", "detection_summary missing 'final_risk_score'", "detection_summary missing 'final_severity'", "detection_summary missing 'ml_anomaly'",
        "detection_summary missing 'rule_anomaly'", "rule_based_evidence must be an array", "ml_based_evidence must be an object or null"],
    4: ["detection_summary must be an object", "record_context must be an object", "sla must be an object or null"],
    5: ["record must be an object"],
}


@query(
    "anomaly_record_conformance", "C16",
    "SELECT event_id, CASE event_id % 11 " + " ".join(f"WHEN {k} THEN {_quote('; '.join(v))}" for k, v in _EXPECTED.items()) + " ELSE '' END AS problems FROM events",
)
def anomaly_record_conformance(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    docs = events.select("event_id", F.expr(_RECORD_SQL).alias("record"))
    return docs.select("event_id", F.concat_ws("; ", va.json_record_errors(F.col("record"))).alias("problems"))


@query(
    "claims_fused_integrity", "C15",
    views.with_views("anomalies") + ", r AS (SELECT signal_count IN (1, 3) AS a, signal_count IN (2, 3) AS b FROM anomalies) "
    "SELECT count(*) AS total_records, count(*) FILTER (a OR b) AS final_anomalies, count(*) FILTER (a) AS gaussian_anomalies, count(*) FILTER (b) AS rule_anomalies, "
    "round(count(*) FILTER (a OR b) * 100.0 / count(*), 4) AS final_anomaly_percentage, 'PASSED' AS status FROM r",
)
def claims_fused_integrity(spark, sf_dir):
    s = F.col("signal_count")
    rows = views.anomalies(spark, sf_dir).select(s.isin(1, 3).alias("a"), s.isin(2, 3).alias("b"))
    rows = rows.withColumn("final", F.col("a") | F.col("b"))
    return va.fused_integrity(rows, "final", {"gaussian_anomalies": flag(F.col("a")), "rule_anomalies": flag(F.col("b"))})
