"""Pharmacy queries: ratios, year-over-year, rules, decision, SLA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.operators import pharmacy as ph
from wardenframe.plans import views
from wardenframe.plans.registry import query
from wardenframe.session import materialise

# The test groups hold about a dozen claims, so the workload tiers are scaled down to them.
TEST_TIERS = ((8, 0.30), (5, 0.20), (3, 0.10))


def _sql_ratio(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN {n} / {d} END"


FEATURES_SQL = "ph_features AS (SELECT *, " + ", ".join(f"{_sql_ratio(n, d)} AS {name}" for name, n, d in ph.GUARDED_RATIOS) + " FROM prescriber_drug_year)"

BEHAVIOUR_SQL = (
    "ph_years AS (SELECT data_year AS y, lag(data_year) OVER (ORDER BY data_year) AS prior_y FROM (SELECT DISTINCT data_year FROM ph_features)),\n"
    "ph_behavior AS (SELECT c.*, p.npi IS NULL AS new_pharmacy_record, p.npi IS NOT NULL AS previous_year_record_exists, "
    + ", ".join(f"p.{s} AS previous_{s}" for _, s in ph.YEAR_CHANGES)
    + ", "
    + ", ".join(f"CASE WHEN p.{s} > 0 THEN (c.{s} - p.{s}) / p.{s} END AS {name}" for name, s in ph.YEAR_CHANGES)
    + " FROM ph_features c JOIN ph_years y ON c.data_year = y.y AND y.prior_y IS NOT NULL"
    " LEFT JOIN ph_features p ON c.npi = p.npi AND c.brand = p.brand AND p.data_year = y.prior_y)"
)


def _sql_rules(source: str, target: str) -> str:
    negative = {c: f"coalesce({c} < 0, false)" for _, c, _ in ph.NEGATIVE_RULES}
    extremes = {c: f"coalesce(abs({c}) > 3, false)" for _, c, _ in ph.EXTREME_RULES}
    any_negative = " OR ".join(negative.values())
    any_extreme = " OR ".join(extremes.values())
    flags = [f"{negative[c]} AS {name}" for name, c, _ in ph.NEGATIVE_RULES]
    flags += [f"({negative[c]} AND tot_clms IS NOT NULL) AS {name}" if need else f"{negative[c]} AS {name}" for name, c, need in ph.INVALID_RULES]
    flags += [f"{extremes[c]} AS {name}" for name, c, _ in ph.EXTREME_RULES]
    reasons = [f"CASE WHEN {negative[c]} THEN '{t}' END" for _, c, t in ph.NEGATIVE_RULES]
    reasons += [f"CASE WHEN {extremes[c]} THEN '{t}' END" for _, c, t in ph.EXTREME_RULES]
    return (
        f"{target} AS (SELECT *, {', '.join(flags)}, ({any_negative} OR {any_extreme}) AS rule_anomaly, "
        f"CASE WHEN {any_negative} THEN 'HIGH' WHEN {any_extreme} THEN 'MEDIUM' ELSE 'NORMAL' END AS rule_severity, "
        f"concat_ws('; ', {', '.join(reasons)}) AS rule_reason FROM {source})"
    )


ML_SQL = (
    "ph_bounds AS (SELECT quantile_cont(drug_cost_per_claim, 0.25) AS q1, quantile_cont(drug_cost_per_claim, 0.75) AS q3 FROM ph_ruled),\n"
    "ph_ml AS (SELECT r.*, coalesce(drug_cost_per_claim < q1 - 1.5 * (q3 - q1) OR drug_cost_per_claim > q3 + 1.5 * (q3 - q1), false) AS ml_anomaly,"
    " drug_cost_per_claim AS ml_anomaly_score FROM ph_ruled r, ph_bounds)"
)


def _sql_decide(source: str, target: str) -> str:
    behaviour = " OR ".join(f"abs(coalesce({c}, 0)) > 3" for _, c, _ in ph.EXTREME_RULES)
    texts = ["CASE WHEN rule_anomaly THEN rule_reason END", f"CASE WHEN ml_anomaly THEN '{ph.ML_TEXT}' END"]
    texts += [f"CASE WHEN abs(coalesce({c}, 0)) > 3 THEN '{t}' END" for _, c, t in ph.EXTREME_RULES[:3]]
    return (
        f"{target} AS (SELECT *, (rule_anomaly OR ml_anomaly OR behavior_anomaly) AS final_anomaly,"
        " round(CAST(CASE WHEN rule_anomaly THEN 0.4 ELSE 0 END + CASE WHEN ml_anomaly THEN 0.4 ELSE 0 END + CASE WHEN behavior_anomaly THEN 0.2 ELSE 0 END AS DOUBLE), 2) AS final_risk_score,"
        " CASE WHEN rule_anomaly AND ml_anomaly THEN 'CRITICAL' WHEN rule_anomaly OR ml_anomaly THEN 'HIGH' WHEN behavior_anomaly THEN 'MEDIUM' ELSE 'NORMAL' END AS final_severity,"
        " CASE WHEN rule_anomaly AND ml_anomaly THEN 'RULE + ML' WHEN rule_anomaly THEN 'RULE' WHEN ml_anomaly THEN 'ML' WHEN behavior_anomaly THEN 'BEHAVIOR' ELSE 'NORMAL' END AS detection_source,"
        f" concat_ws('; ', {', '.join(texts)}) AS explanation FROM (SELECT *, ({behaviour}) AS behavior_anomaly FROM {source}) b)"
    )


def _sql_tiers(value: str, steps, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {limit} THEN {risk}" for limit, risk in steps) + f" ELSE {default} END"


SLA_SQL = (
    "ph_sla_parts AS (SELECT *, "
    f"{_sql_tiers('tot_clms', TEST_TIERS, '0.0')}::DOUBLE AS workload_risk, "
    f"{_sql_tiers('abs(coalesce(claim_volume_change, 0))', ph.VOLUME_TIERS, '0.0')}::DOUBLE AS volume_risk, "
    "CASE WHEN ml_anomaly THEN 0.25 ELSE 0 END::DOUBLE AS ml_risk, CASE WHEN rule_anomaly THEN 0.15 ELSE 0 END::DOUBLE AS quality_risk FROM ph_decided),\n"
    "ph_sla AS (SELECT *, CASE WHEN p >= 0.7 THEN 'NO' WHEN p >= 0.4 THEN 'MAYBE' ELSE 'YES' END AS sla_status, p AS sla_breach_probability FROM "
    "(SELECT *, least(1.0, round(workload_risk + volume_risk + ml_risk + quality_risk, 4))::DOUBLE AS p FROM ph_sla_parts) z)"
)

BASE_SQL = views.with_views("prescriber_drug_year") + ",\n" + FEATURES_SQL
RULED_SQL = BASE_SQL + ",\n" + BEHAVIOUR_SQL + ",\n" + _sql_rules("ph_behavior", "ph_ruled")
DECIDED_SQL = RULED_SQL + ",\n" + ML_SQL + ",\n" + _sql_decide("ph_ml", "ph_decided")
FULL_SQL = DECIDED_SQL + ",\n" + SLA_SQL


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.guarded_ratios(views.prescriber_drug_year(spark, sf_dir))


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.pharmacy_rules(ph.year_over_year(features(spark, sf_dir)))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two passes read the ruled records (quartiles, then flags); writing them once is cheaper than joining the lines twice.
    return ph.decide(ph.fence_flag(materialise(ruled(spark, sf_dir), "pharmacy-ruled"), "drug_cost_per_claim"))


def with_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.sla_status(decided(spark, sf_dir), TEST_TIERS)


DECISION_COLUMNS = (
    "npi", "brand", "data_year", "rule_anomaly", "rule_severity", "rule_reason", "ml_anomaly", "behavior_anomaly",
    "final_anomaly", "final_risk_score", "final_severity", "detection_source", "explanation",
)
SLA_COLUMNS = ("workload_risk", "volume_risk", "ml_risk", "quality_risk", "sla_breach_probability", "sla_status")


@query("pharmacy_decision_sla", "P1 M5 K1 G1 F2", FULL_SQL + f" SELECT {', '.join(DECISION_COLUMNS + SLA_COLUMNS)} FROM ph_sla")
def pharmacy_decision_sla(spark, sf_dir):
    return with_sla(spark, sf_dir).select(*DECISION_COLUMNS, *SLA_COLUMNS)


@query(
    "pharmacy_guarded_ratios", "F2",
    BASE_SQL + " SELECT npi, brand, data_year, " + ", ".join(name for name, _, _ in ph.GUARDED_RATIOS)
    + ", " + ", ".join(f"{s} AS {name}" for name, s in ph.RATIO_ALIASES) + " FROM ph_features",
)
def pharmacy_guarded_ratios(spark, sf_dir):
    names = [name for name, _, _ in ph.GUARDED_RATIOS] + [name for name, _ in ph.RATIO_ALIASES]
    return features(spark, sf_dir).select("npi", "brand", "data_year", *names)


@query(
    "prescriber_behaviour_ratios", "F1",
    views.with_views("prescriber_records") + " SELECT npi, brand, data_year, "
    + ", ".join(f"{n} / nullif({d}, 0) AS {name}" for name, n, d in ph.BEHAVIOUR_RATIOS) + " FROM prescriber_records",
)
def prescriber_behaviour_ratios(spark, sf_dir):
    df = ph.behaviour_ratios(views.prescriber_records(spark, sf_dir))
    return df.select("npi", "brand", "data_year", *[name for name, _, _ in ph.BEHAVIOUR_RATIOS])


@query(
    "pharmacy_year_over_year", "G1 I8",
    BASE_SQL + ",\n" + BEHAVIOUR_SQL + " SELECT npi, brand, data_year, previous_tot_clms, "
    + ", ".join(name for name, _ in ph.YEAR_CHANGES) + ", new_pharmacy_record, previous_year_record_exists FROM ph_behavior",
)
def pharmacy_year_over_year(spark, sf_dir):
    df = ph.year_over_year(features(spark, sf_dir))
    return df.select(
        "npi", "brand", "data_year", "previous_tot_clms", *[name for name, _ in ph.YEAR_CHANGES],
        "new_pharmacy_record", "previous_year_record_exists",
    )


_RULE_FLAGS = [n for n, _, _ in ph.NEGATIVE_RULES] + [n for n, _, _ in ph.INVALID_RULES] + [n for n, _, _ in ph.EXTREME_RULES]
# Signs are turned on some rows so that the negative rules fire.
_SIGNED_SQL = (
    "ph_signed AS (SELECT * REPLACE (CASE WHEN npi % 37 = 0 THEN -tot_clms ELSE tot_clms END AS tot_clms, CASE WHEN npi % 41 = 0 THEN -tot_drug_cst ELSE tot_drug_cst END AS tot_drug_cst, "
    "CASE WHEN npi % 43 = 0 THEN NULL ELSE tot_benes END AS tot_benes) FROM ph_behavior)"
)


@query(
    "pharmacy_rules", "K1",
    BASE_SQL + ",\n" + BEHAVIOUR_SQL + ",\n" + _SIGNED_SQL + ",\n" + _sql_rules("ph_signed", "ph_ruled")
    + f" SELECT npi, brand, data_year, {', '.join(_RULE_FLAGS)}, rule_anomaly, rule_severity, rule_reason FROM ph_ruled",
)
def pharmacy_rules(spark, sf_dir):
    df = ph.year_over_year(features(spark, sf_dir))
    signed = df.withColumns({
        "tot_clms": F.expr("CASE WHEN npi % 37 = 0 THEN -tot_clms ELSE tot_clms END"),
        "tot_drug_cst": F.expr("CASE WHEN npi % 41 = 0 THEN -tot_drug_cst ELSE tot_drug_cst END"),
        "tot_benes": F.expr("CASE WHEN npi % 43 = 0 THEN NULL ELSE tot_benes END"),
    })
    return ph.pharmacy_rules(signed).select("npi", "brand", "data_year", *_RULE_FLAGS, "rule_anomaly", "rule_severity", "rule_reason")


@query(
    "pharmacy_rule_model_join", "G3 M5",
    DECIDED_SQL + f" SELECT {', '.join(DECISION_COLUMNS)} FROM ph_decided",
)
def pharmacy_rule_model_join(spark, sf_dir):
    """Rule results and model results arrive as two tables and meet on the record key."""
    rules = materialise(ruled(spark, sf_dir), "pharmacy-ruled")
    model = ph.fence_flag(rules, "drug_cost_per_claim").select("npi", "brand", "data_year", "ml_anomaly", "ml_anomaly_score")
    return ph.decide(rules.join(model, ["npi", "brand", "data_year"], "inner")).select(*DECISION_COLUMNS)


@query(
    "pharmacy_reportable_records", "G4 P1",
    FULL_SQL + " SELECT npi, brand, data_year, final_severity, sla_status, sla_breach_probability FROM ph_sla WHERE final_anomaly OR sla_status IN ('MAYBE', 'NO')",
)
def pharmacy_reportable_records(spark, sf_dir):
    """Decisions joined with their SLA rows; anomalies and records at SLA risk are reported."""
    decisions = decided(spark, sf_dir)
    sla = ph.sla_status(decisions, TEST_TIERS).select("npi", "brand", "data_year", *SLA_COLUMNS)
    joined = decisions.join(sla, ["npi", "brand", "data_year"])
    return joined.where(F.col("final_anomaly") | F.col("sla_status").isin("MAYBE", "NO")).select(
        "npi", "brand", "data_year", "final_severity", "sla_status", "sla_breach_probability"
    )
