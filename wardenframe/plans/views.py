"""Domain views over the given star schema, as DataFrames and as SQL text for the cross-check.

The given tables carry no NULLs, so dirt is derived from keys and stays deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.operators.claims import REASONS
from wardenframe.sources.tables import read_table


def money(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


# ---------------------------------------------------------------- pharmacy

PRESCRIBER_DRUG_YEAR = """
prescriber_drug_year AS (
  SELECT l.l_suppkey AS npi, p.p_brand AS brand, year(l.l_shipdate) AS data_year,
         CAST(count(*) AS DOUBLE) AS tot_clms,
         round(CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 30, 4) AS tot_30day_fills,
         CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS tot_day_suply,
         CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS tot_drug_cst,
         CAST(count(DISTINCT o.o_custkey) AS DOUBLE) AS tot_benes
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_suppkey, p.p_brand, year(l.l_shipdate)
)"""


def prescriber_drug_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    parts = read_table(spark, sf_dir, "part")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    supply = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return joined.groupBy(
        F.col("l_suppkey").alias("npi"), F.col("p_brand").alias("brand"), F.year("l_shipdate").alias("data_year")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("tot_clms"),
        F.round(supply / 30, 4).alias("tot_30day_fills"),
        supply.alias("tot_day_suply"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("tot_drug_cst"),
        F.countDistinct("o_custkey").cast("double").alias("tot_benes"),
    )


# The same records with gaps, sign errors and older-patient totals, for the prescriber rule set.
PRESCRIBER_RECORDS = """
prescriber_records AS (
  SELECT npi, brand, data_year,
         CASE WHEN (npi * 7 + data_year) % 41 = 0 THEN NULL ELSE concat('CITY', CAST(npi % 60 AS VARCHAR)) END AS city,
         CASE WHEN (npi + data_year) % 5 = 0 THEN 'Pharmacy' ELSE 'Internal Medicine' END AS prescriber_type,
         CASE WHEN (npi * 3 + data_year) % 47 = 0 THEN 0.0 WHEN (npi * 5 + data_year) % 59 = 0 THEN -tot_clms ELSE tot_clms END AS tot_clms,
         tot_30day_fills,
         CASE WHEN (npi * 11 + data_year) % 53 = 0 THEN 0.0 ELSE tot_day_suply END AS tot_day_suply,
         CASE WHEN (npi * 13 + data_year) % 61 = 0 THEN -tot_drug_cst ELSE tot_drug_cst END AS tot_drug_cst,
         CASE WHEN (npi * 17 + data_year) % 43 = 0 THEN 0.0 ELSE tot_benes END AS tot_benes,
         CASE WHEN (npi + data_year) % 37 = 0 THEN tot_clms + 1 ELSE floor(tot_clms / 2) END AS ge65_tot_clms,
         CASE WHEN (npi + data_year) % 31 = 0 THEN '*' WHEN (npi + data_year) % 29 = 0 THEN 'N' ELSE '' END AS ge65_sprsn_flag
  FROM prescriber_drug_year
)"""


def prescriber_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prescriber_drug_year(spark, sf_dir).selectExpr(
        "npi",
        "brand",
        "data_year",
        "CASE WHEN (npi * 7 + data_year) % 41 = 0 THEN NULL ELSE concat('CITY', CAST(npi % 60 AS STRING)) END AS city",
        "CASE WHEN (npi + data_year) % 5 = 0 THEN 'Pharmacy' ELSE 'Internal Medicine' END AS prescriber_type",
        "CASE WHEN (npi * 3 + data_year) % 47 = 0 THEN 0.0D WHEN (npi * 5 + data_year) % 59 = 0 THEN -tot_clms ELSE tot_clms END AS tot_clms",
        "tot_30day_fills",
        "CASE WHEN (npi * 11 + data_year) % 53 = 0 THEN 0.0D ELSE tot_day_suply END AS tot_day_suply",
        "CASE WHEN (npi * 13 + data_year) % 61 = 0 THEN -tot_drug_cst ELSE tot_drug_cst END AS tot_drug_cst",
        "CASE WHEN (npi * 17 + data_year) % 43 = 0 THEN 0.0D ELSE tot_benes END AS tot_benes",
        "CASE WHEN (npi + data_year) % 37 = 0 THEN tot_clms + 1 ELSE CAST(floor(tot_clms / 2) AS DOUBLE) END AS ge65_tot_clms",
        "CASE WHEN (npi + data_year) % 31 = 0 THEN '*' WHEN (npi + data_year) % 29 = 0 THEN 'N' ELSE '' END AS ge65_sprsn_flag",
    )


# ---------------------------------------------------------------- claims, as landed in a file

CLAIMS_RAW = """
claims_raw AS (
  SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS claim_id,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN '  ' ELSE concat('M', CAST(l_partkey AS VARCHAR)) END AS member_id,
         concat('P', CAST(l_suppkey AS VARCHAR)) AS provider_id,
         CASE WHEN l_partkey % 101 = 0 THEN 'NOT_A_DATE' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS claim_date,
         CASE WHEN l_partkey % 103 = 0 THEN 'ABC' WHEN l_partkey % 107 = 0 THEN '-50.00' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS claim_amount,
         CASE WHEN l_partkey % 109 = 0 THEN 'UNKNOWN' WHEN l_returnflag = 'R' THEN 'DENIED' WHEN l_returnflag = 'A' THEN 'PENDING' ELSE 'PAID' END AS claim_status,
         CASE WHEN l_returnflag = 'R' AND l_linenumber <> 3 THEN concat('D0', CAST(l_linenumber AS VARCHAR)) ELSE '' END AS denial_code
  FROM lineitem
)"""

CLAIMS_COLUMNS = ("claim_id", "member_id", "provider_id", "claim_date", "claim_amount", "claim_status", "denial_code")


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_columns(read_table(spark, sf_dir, "lineitem"))


def claims_columns(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS claim_id",
        "CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN '  ' ELSE concat('M', CAST(l_partkey AS STRING)) END AS member_id",
        "concat('P', CAST(l_suppkey AS STRING)) AS provider_id",
        "CASE WHEN l_partkey % 101 = 0 THEN 'NOT_A_DATE' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS claim_date",
        "CASE WHEN l_partkey % 103 = 0 THEN 'ABC' WHEN l_partkey % 107 = 0 THEN '-50.00' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS claim_amount",
        "CASE WHEN l_partkey % 109 = 0 THEN 'UNKNOWN' WHEN l_returnflag = 'R' THEN 'DENIED' WHEN l_returnflag = 'A' THEN 'PENDING' ELSE 'PAID' END AS claim_status",
        "CASE WHEN l_returnflag = 'R' AND l_linenumber <> 3 THEN concat('D0', CAST(l_linenumber AS STRING)) ELSE '' END AS denial_code",
    )


# ---------------------------------------------------------------- authorization

AUTH_RECORDS = """
auth_records AS (
  SELECT concat('AUTH', CAST(o_orderkey AS VARCHAR)) AS authorization_id,
         CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS patient_id,
         concat('PR', CAST(o_custkey % 50 AS VARCHAR)) AS provider_id,
         CASE WHEN o_orderkey % 79 = 0 THEN 'bad-date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS request_date,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 - 2 AS INT) AS VARCHAR) AS approval_date,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) AS VARCHAR) AS valid_from_date,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 1 AS INT) AS VARCHAR) AS valid_to_date,
         o_orderpriority AS authorization_type,
         concat(CASE WHEN o_orderkey % 3 = 0 THEN 'CPT' ELSE 'hcpcs' END, CAST(o_orderkey % 40 AS VARCHAR)) AS service_code,
         CAST(CASE WHEN o_orderkey % 211 = 0 THEN -1 WHEN o_orderkey % 223 = 0 THEN 500 ELSE o_orderkey % 12 + 1 END AS DOUBLE) AS requested_quantity,
         CASE WHEN o_orderkey % 227 = 0 THEN -o_totalprice ELSE o_totalprice END AS charged_amount,
         o_orderstatus AS approval_status
  FROM orders
)"""


def auth_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").selectExpr(
        "concat('AUTH', CAST(o_orderkey AS STRING)) AS authorization_id",
        "CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS patient_id",
        "concat('PR', CAST(o_custkey % 50 AS STRING)) AS provider_id",
        "CASE WHEN o_orderkey % 79 = 0 THEN 'bad-date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS request_date",
        "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 - 2 AS INT) AS STRING) AS approval_date",
        "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) AS STRING) AS valid_from_date",
        "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 1 AS INT) AS STRING) AS valid_to_date",
        "o_orderpriority AS authorization_type",
        "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'CPT' ELSE 'hcpcs' END, CAST(o_orderkey % 40 AS STRING)) AS service_code",
        "CAST(CASE WHEN o_orderkey % 211 = 0 THEN -1 WHEN o_orderkey % 223 = 0 THEN 500 ELSE o_orderkey % 12 + 1 END AS DOUBLE) AS requested_quantity",
        "CASE WHEN o_orderkey % 227 = 0 THEN -o_totalprice ELSE o_totalprice END AS charged_amount",
        "o_orderstatus AS approval_status",
    )


# ---------------------------------------------------------------- claims transparency grain

PLAN_CLAIMS = """
plan_claims AS (
  SELECT concat('PLAN', CAST(l_partkey % 40 AS VARCHAR)) AS plan_id, l_suppkey AS issuer_id,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS received_in_network,
         CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS received_out_network,
         CAST(sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS denied_in_network,
         CAST(sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS denied_out_network,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS resubmitted,
         CAST(sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS internal_appeals,
         CAST(sum(CASE WHEN l_linenumber = 1 AND l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) AS internal_overturned,
         CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) END AS avg_monthly_enrollment,
         CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS avg_monthly_disenrollment
  FROM lineitem
  GROUP BY l_partkey % 40, l_suppkey
)"""


def plan_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")

    def tally(predicate: str):
        return F.count_if(F.expr(predicate)).cast("double")

    return (
        lines.groupBy((F.col("l_partkey") % 40).alias("plan_no"), F.col("l_suppkey").alias("issuer_id"))
        .agg(
            tally("l_linestatus = 'O'").alias("received_in_network"),
            tally("l_linestatus = 'F'").alias("received_out_network"),
            tally("l_linestatus = 'O' AND l_returnflag = 'R'").alias("denied_in_network"),
            tally("l_linestatus = 'F' AND l_returnflag = 'R'").alias("denied_out_network"),
            tally("l_returnflag = 'A'").alias("resubmitted"),
            tally("l_linenumber = 1").alias("internal_appeals"),
            tally("l_linenumber = 1 AND l_quantity > 25").alias("internal_overturned"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("enrollment"),
            F.countDistinct("l_orderkey").cast("double").alias("avg_monthly_disenrollment"),
        )
        .select(
            F.concat(F.lit("PLAN"), F.col("plan_no").cast("string")).alias("plan_id"),
            "issuer_id",
            "received_in_network",
            "received_out_network",
            "denied_in_network",
            "denied_out_network",
            "resubmitted",
            "internal_appeals",
            "internal_overturned",
            F.when(F.col("issuer_id") % 13 != 0, F.col("enrollment")).alias("avg_monthly_enrollment"),
            "avg_monthly_disenrollment",
        )
    )


# The full transparency layout: plan and issuer level counts, ten denial reasons, seeded errors.
PLAN_ISSUER = (
    "plan_issuer AS (\n  SELECT plan_id, issuer_id,\n"
    "    plan_received_in_network, plan_received_out_network,\n"
    "    CASE WHEN (issuer_id + plan_no) % 19 = 0 THEN plan_received_in_network + 2 ELSE plan_denied_in_network END AS plan_denied_in_network,\n"
    "    plan_denied_out_network,\n"
    "    CASE WHEN (issuer_id + plan_no) % 23 = 0 THEN -1.0 ELSE plan_resubmitted_in_network END AS plan_resubmitted_in_network,\n"
    "    plan_resubmitted_out_network,\n"
    "    sum(plan_received_in_network) OVER w AS issuer_received_in_network,\n"
    "    sum(plan_received_out_network) OVER w AS issuer_received_out_network,\n"
    "    sum(plan_denied_in_network) OVER w AS issuer_denied_in_network,\n"
    "    sum(plan_denied_out_network) OVER w AS issuer_denied_out_network,\n"
    "    sum(plan_resubmitted_in_network) OVER w AS issuer_resubmitted_in_network,\n"
    "    sum(plan_resubmitted_out_network) OVER w AS issuer_resubmitted_out_network,\n"
    "    internal_appeals_filed,\n"
    "    CASE WHEN (issuer_id + plan_no) % 29 = 0 THEN internal_appeals_filed + 1 ELSE internal_overturned END AS internal_overturned,\n"
    "    CASE WHEN (issuer_id + plan_no) % 31 = 0 THEN 120.0 ELSE 50.0 END AS percent_internal_overturned,\n"
    "    CASE WHEN issuer_id % 7 = 0 THEN NULL ELSE external_appeals_filed END AS external_appeals_filed,\n"
    "    CASE WHEN issuer_id % 7 = 0 THEN NULL ELSE external_overturned END AS external_overturned,\n"
    "    CASE WHEN issuer_id % 7 = 0 THEN NULL WHEN (issuer_id + plan_no) % 37 = 0 THEN -5.0 ELSE 40.0 END AS percent_external_overturned,\n"
    + "".join(f"    denied_{r},\n" for r in REASONS)
    + "    CASE WHEN issuer_id % 13 = 0 THEN NULL ELSE enrollment END AS avg_monthly_enrollment,\n"
    "    CASE WHEN issuer_id % 13 = 0 THEN NULL WHEN (issuer_id + plan_no) % 41 = 0 THEN enrollment + 5 ELSE disenrollment END AS avg_monthly_disenrollment\n"
    "  FROM (SELECT l_partkey % 40 AS plan_no, concat('PLAN', CAST(l_partkey % 40 AS VARCHAR)) AS plan_id, l_suppkey AS issuer_id,\n"
    "    CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS plan_received_in_network,\n"
    "    CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS plan_received_out_network,\n"
    "    CAST(sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS plan_denied_in_network,\n"
    "    CAST(sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS plan_denied_out_network,\n"
    "    CAST(sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS plan_resubmitted_in_network,\n"
    "    CAST(sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS plan_resubmitted_out_network,\n"
    "    CAST(sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS internal_appeals_filed,\n"
    "    CAST(sum(CASE WHEN l_linenumber = 1 AND l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) AS internal_overturned,\n"
    "    CAST(sum(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS external_appeals_filed,\n"
    "    CAST(sum(CASE WHEN l_linenumber = 2 AND l_quantity > 30 THEN 1 ELSE 0 END) AS DOUBLE) AS external_overturned,\n"
    + "".join(
        f"    CAST(sum(CASE WHEN l_returnflag = 'R' AND l_partkey % 10 = {i} THEN 1 ELSE 0 END) AS DOUBLE) AS denied_{r},\n"
        for i, r in enumerate(REASONS)
    )
    + "    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS enrollment,\n"
    "    CAST(count(*) AS DOUBLE) AS disenrollment\n"
    "    FROM lineitem GROUP BY l_partkey % 40, l_suppkey) g\n"
    "  WINDOW w AS (PARTITION BY issuer_id)\n)"
)


def plan_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")

    def tally(predicate: str):
        return F.count_if(F.expr(predicate)).cast("double")

    plans = lines.groupBy((F.col("l_partkey") % 40).alias("plan_no"), F.col("l_suppkey").alias("issuer_id")).agg(
        tally("l_linestatus = 'O'").alias("plan_received_in_network"),
        tally("l_linestatus = 'F'").alias("plan_received_out_network"),
        tally("l_linestatus = 'O' AND l_returnflag = 'R'").alias("plan_denied_in"),
        tally("l_linestatus = 'F' AND l_returnflag = 'R'").alias("plan_denied_out_network"),
        tally("l_linestatus = 'O' AND l_returnflag = 'A'").alias("plan_resubmitted_in"),
        tally("l_linestatus = 'F' AND l_returnflag = 'A'").alias("plan_resubmitted_out_network"),
        tally("l_linenumber = 1").alias("internal_appeals_filed"),
        tally("l_linenumber = 1 AND l_quantity > 25").alias("overturned_inside"),
        tally("l_linenumber = 2").alias("external_filed"),
        tally("l_linenumber = 2 AND l_quantity > 30").alias("external_won"),
        *[tally(f"l_returnflag = 'R' AND l_partkey % 10 = {i}").alias(f"denied_{r}") for i, r in enumerate(REASONS)],
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("enrollment"),
        F.count(F.lit(1)).cast("double").alias("disenrollment"),
    )
    # Issuer totals: aggregate the already small plan rows once more and join them back.
    issuers = plans.groupBy("issuer_id").agg(
        F.sum("plan_received_in_network").alias("issuer_received_in_network"),
        F.sum("plan_received_out_network").alias("issuer_received_out_network"),
        F.sum("plan_denied_in").alias("issuer_denied_in_network"),
        F.sum("plan_denied_out_network").alias("issuer_denied_out_network"),
        F.sum("plan_resubmitted_in").alias("issuer_resubmitted_in_network"),
        F.sum("plan_resubmitted_out_network").alias("issuer_resubmitted_out_network"),
    )
    mark = "(issuer_id + plan_no)"
    return plans.join(issuers, "issuer_id").selectExpr(
        "concat('PLAN', CAST(plan_no AS STRING)) AS plan_id",
        "issuer_id",
        "plan_received_in_network",
        "plan_received_out_network",
        f"CASE WHEN {mark} % 19 = 0 THEN plan_received_in_network + 2 ELSE plan_denied_in END AS plan_denied_in_network",
        "plan_denied_out_network",
        f"CASE WHEN {mark} % 23 = 0 THEN -1.0D ELSE plan_resubmitted_in END AS plan_resubmitted_in_network",
        "plan_resubmitted_out_network",
        "issuer_received_in_network",
        "issuer_received_out_network",
        "issuer_denied_in_network",
        "issuer_denied_out_network",
        "issuer_resubmitted_in_network",
        "issuer_resubmitted_out_network",
        "internal_appeals_filed",
        f"CASE WHEN {mark} % 29 = 0 THEN internal_appeals_filed + 1 ELSE overturned_inside END AS internal_overturned",
        f"CASE WHEN {mark} % 31 = 0 THEN 120.0D ELSE 50.0D END AS percent_internal_overturned",
        "CASE WHEN issuer_id % 7 = 0 THEN NULL ELSE external_filed END AS external_appeals_filed",
        "CASE WHEN issuer_id % 7 = 0 THEN NULL ELSE external_won END AS external_overturned",
        f"CASE WHEN issuer_id % 7 = 0 THEN NULL WHEN {mark} % 37 = 0 THEN -5.0D ELSE 40.0D END AS percent_external_overturned",
        *[f"denied_{r}" for r in REASONS],
        "CASE WHEN issuer_id % 13 = 0 THEN NULL ELSE enrollment END AS avg_monthly_enrollment",
        f"CASE WHEN issuer_id % 13 = 0 THEN NULL WHEN {mark} % 41 = 0 THEN enrollment + 5 ELSE disenrollment END AS avg_monthly_disenrollment",
    )


# ---------------------------------------------------------------- anomaly store and feed

ANOMALIES = """
anomalies AS (
  SELECT CAST(event_id AS VARCHAR) AS id, concat('C', CAST(user_id AS VARCHAR)) AS record_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'CLAIMS' WHEN event_type = 'purchase' THEN 'PHARMACY' ELSE 'AUTHORIZATION' END AS source_dataset,
         CASE WHEN event_type = 'error' THEN 'NEGATIVE_VALUE' WHEN event_type = 'signup' THEN 'MISSING_FIELD' ELSE 'INVALID_DOMAIN' END AS anomaly_type,
         CASE WHEN value >= 160 THEN 'CRITICAL' WHEN value >= 80 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         CASE WHEN event_id % 4 = 0 THEN 'OPEN' WHEN event_id % 4 = 1 THEN 'IN_PROGRESS' WHEN event_id % 4 = 2 THEN 'RESOLVED' ELSE 'IGNORED' END AS status,
         CAST(event_id % 4 AS INT) AS signal_count, value AS score, ts AS detected_at
  FROM events
)"""


def anomaly_columns(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "CAST(event_id AS STRING) AS id",
        "concat('C', CAST(user_id AS STRING)) AS record_id",
        "CASE WHEN event_type IN ('click', 'view') THEN 'CLAIMS' WHEN event_type = 'purchase' THEN 'PHARMACY' ELSE 'AUTHORIZATION' END AS source_dataset",
        "CASE WHEN event_type = 'error' THEN 'NEGATIVE_VALUE' WHEN event_type = 'signup' THEN 'MISSING_FIELD' ELSE 'INVALID_DOMAIN' END AS anomaly_type",
        "CASE WHEN value >= 160 THEN 'CRITICAL' WHEN value >= 80 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity",
        "CASE WHEN event_id % 4 = 0 THEN 'OPEN' WHEN event_id % 4 = 1 THEN 'IN_PROGRESS' WHEN event_id % 4 = 2 THEN 'RESOLVED' ELSE 'IGNORED' END AS status",
        "CAST(event_id % 4 AS INT) AS signal_count",
        "value AS score",
        "ts AS detected_at",
    )


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly_columns(read_table(spark, sf_dir, "events"))


_VIEW_SQL = {
    "prescriber_drug_year": (PRESCRIBER_DRUG_YEAR,),
    "prescriber_records": (PRESCRIBER_DRUG_YEAR, PRESCRIBER_RECORDS),
    "claims_raw": (CLAIMS_RAW,),
    "auth_records": (AUTH_RECORDS,),
    "plan_claims": (PLAN_CLAIMS,),
    "plan_issuer": (PLAN_ISSUER,),
    "anomalies": (ANOMALIES,),
}


def with_views(*names: str) -> str:
    """``WITH`` clause (without a trailing comma) that defines the named views."""
    parts: list[str] = []
    for name in names:
        for text in _VIEW_SQL[name]:
            if text not in parts:
                parts.append(text)
    return "WITH " + ",\n".join(p.strip() for p in parts)
