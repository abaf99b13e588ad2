"""Prescriber rule set, evidence scoring, fusion, causes and the prescriber SLA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.operators import causes as ca
from wardenframe.operators import pharmacy as ph
from wardenframe.operators import prescriber as ps
from wardenframe.operators import sla
from wardenframe.plans import views
from wardenframe.plans.registry import query

# Records before this year are the history, the others are current.
SPLIT_YEAR = 1998
# Limits scaled to the test data, where a group holds a dozen claims and a line costs tens of thousands.
LIMITS = {
    "cost_per_claim_high": 45000.0, "cost_per_claim_medium": 38000.0, "cost_per_beneficiary_high": 50000.0, "cost_per_beneficiary_medium": 40000.0,
    "cost_per_day_supply_high": 2200.0, "cost_per_day_supply_medium": 1700.0, "day_supply_per_claim_high": 36.0, "day_supply_per_claim_medium": 30.0,
    "fills_per_claim_high": 1.2, "fills_per_claim_medium": 1.0, "claims_per_beneficiary_high": 1.5, "claims_per_beneficiary_medium": 1.2,
    "minimum_claims_for_ratio": 2.0,
}
ALL_LIMITS = {**ps.THRESHOLDS, **LIMITS}
KEYS = ("npi", "brand", "data_year")
K = "npi, brand, data_year"

HISTORY_SQL = (
    views.with_views("prescriber_records") + ",\nhist AS (SELECT npi, " + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) AS historical_{c}" for c in ps.HISTORY_METRICS.values())
    + f" FROM prescriber_records WHERE data_year < {SPLIT_YEAR} GROUP BY npi),\npr_base AS (SELECT c.*, " + ", ".join(f"h.historical_{c}" for c in ps.HISTORY_METRICS.values()) + ", "
    + ", ".join(f"(c.{c} - h.historical_{c}) / nullif(h.historical_{c}, 0) AS {n}" for n, c in ps.HISTORY_METRICS.items())
    + ", (c.tot_drug_cst / nullif(c.tot_clms, 0) - h.historical_tot_drug_cst / nullif(h.historical_tot_clms, 0)) / nullif(h.historical_tot_drug_cst / nullif(h.historical_tot_clms, 0), 0) AS cost_per_claim_change, "
    + ", ".join(f"c.{n} / nullif(c.{d}, 0) AS {name}" for name, n, d in ph.BEHAVIOUR_RATIOS)
    + f" FROM prescriber_records c LEFT JOIN hist h ON c.npi = h.npi WHERE c.data_year >= {SPLIT_YEAR})"
)
_CHANGES = (*ps.HISTORY_METRICS, "cost_per_claim_change")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = views.prescriber_records(spark, sf_dir)
    current = ph.behaviour_ratios(records.where(F.col("data_year") >= SPLIT_YEAR))
    return ps.history_change(current, records.where(F.col("data_year") < SPLIT_YEAR))


@query("prescriber_history_change", "G2 H5", HISTORY_SQL + f" SELECT {K}, historical_tot_clms, {', '.join(_CHANGES)} FROM pr_base")
def prescriber_history_change(spark, sf_dir):
    return base(spark, sf_dir).select(*KEYS, "historical_tot_clms", *_CHANGES)


def _rules_sql() -> list[tuple[str, str, str, str]]:
    """(rule, severity, class, predicate) in evaluation order."""
    lim = ALL_LIMITS
    rules = [("missing_critical_value", "MEDIUM", "npi IS NULL OR city IS NULL OR prescriber_type IS NULL OR brand IS NULL")]
    rules += [("negative_value", "HIGH", f"{c} < 0") for c in ("tot_clms", "tot_30day_fills", "tot_day_suply", "tot_drug_cst", "tot_benes", "ge65_tot_clms")]
    rules += [
        ("fills_without_claims", "HIGH", "tot_clms = 0 AND tot_30day_fills > 0"),
        ("claims_without_day_supply", "MEDIUM", "tot_clms > 0 AND tot_day_suply = 0"),
        ("cost_without_claims", "HIGH", "tot_clms = 0 AND tot_drug_cst > 0"),
        ("claims_without_beneficiaries", "MEDIUM", "tot_clms > 0 AND tot_benes = 0"),
    ]
    for ratio, activity, minimum, _ in ps.RATIO_RULES:
        active = f"{activity} > 0" if minimum is None else f"{activity} >= {lim[minimum]}"
        rules.append((f"{ratio}_high", "HIGH", f"{active} AND {ratio} >= {lim[f'{ratio}_high']}"))
        rules.append((f"{ratio}_medium", "MEDIUM", f"{active} AND {ratio} >= {lim[f'{ratio}_medium']} AND {ratio} < {lim[f'{ratio}_high']}"))
    for change, _ in ps.CHANGE_RULES:
        rules.append((change, "HIGH", f"abs({change}) >= {lim[f'{change}_high']}"))
        rules.append((change, "MEDIUM", f"abs({change}) >= {lim[f'{change}_medium']} AND abs({change}) < {lim[f'{change}_high']}"))
    rules.append(("ge65_exceeds_total", "HIGH", "ge65_tot_clms >= 0 AND tot_clms >= 0 AND ge65_tot_clms > tot_clms"))
    return [(r, s, ps.RULE_CLASSES[r], p) for r, s, p in rules]


RULES = _rules_sql()
_SEV = {"HIGH": 0.75, "MEDIUM": 0.45}
_CLS = {"HARD_ANOMALY": 1.0, "DATA_QUALITY": 0.85, "BEHAVIOR_EVIDENCE": 0.65}


def _evidence_list(extra: str) -> str:
    items = ", ".join(
        f"CASE WHEN coalesce({p}, false) THEN {{'r': '{r}', 's': '{s}', 'c': '{c}', 'v': {round(_SEV[s] * _CLS[c], 4)}::DOUBLE}} END" for r, s, c, p in RULES
    )
    return f"list_filter([{items}], lambda x: x IS NOT NULL) AS {extra}"


RULED_SQL = (
    HISTORY_SQL + f",\npr_ruled AS (SELECT *, {_evidence_list('e')}, upper(trim(ge65_sprsn_flag)) NOT IN ('', 'N', 'NO', '0', 'FALSE', 'NONE', 'NAN') AS suppressed FROM pr_base)"
)
_MAX_SEVERITY = "CASE WHEN len(list_filter(e, lambda x: x.s = 'HIGH')) > 0 THEN 'HIGH' WHEN len(e) > 0 THEN 'MEDIUM' ELSE 'NONE' END"


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.evaluate(base(spark, sf_dir), LIMITS)


@query(
    "prescriber_rules", "K2 K3",
    RULED_SQL + f" SELECT {K}, array_to_string(list_transform(e, lambda x: concat(x.r, ':', x.s)), ',') AS evidence, len(e) > 0 AS rule_anomaly, {_MAX_SEVERITY} AS rule_severity, CAST(len(e) AS INT) AS rule_count, "
    "CASE WHEN suppressed THEN 1 ELSE 0 END AS context_count FROM pr_ruled",
)
def prescriber_rules(spark, sf_dir):
    text = F.array_join(F.transform("reasons", lambda e: F.concat(e["rule"], F.lit(":"), e["severity"])), ",")
    return evaluated(spark, sf_dir).select(*KEYS, text.alias("evidence"), "rule_anomaly", "rule_severity", "rule_count", F.size("context_reasons").alias("context_count"))


def _has(kind: str) -> str:
    return f"len(list_filter(e, lambda x: x.c = '{kind}')) > 0"


@query(
    "prescriber_evidence_classes", "K8",
    RULED_SQL + f" SELECT {K}, {_has('HARD_ANOMALY')} AS hard_anomaly, {_has('BEHAVIOR_EVIDENCE')} AS behavior_anomaly, {_has('DATA_QUALITY')} AS data_quality_issue, suppressed AS context_present, "
    "CAST(len(e) + CAST(suppressed AS INT) AS INT) AS total_evidence FROM pr_ruled",
)
def prescriber_evidence_classes(spark, sf_dir):
    return ps.classify(evaluated(spark, sf_dir)).select(*KEYS, "hard_anomaly", "behavior_anomaly", "data_quality_issue", "context_present", "total_evidence")


@query(
    "prescriber_inferred_classes", "K9 N9",
    RULED_SQL + f" SELECT {K}, array_to_string(list_transform(e, lambda x: concat(x.r, '=', CASE WHEN regexp_matches(x.r, 'drug_cost_change|claim_volume_change|fill_volume_change|days_supply_change|beneficiary_change|cost_per_claim_change') THEN 'BEHAVIOR_EVIDENCE' "
    "WHEN regexp_matches(x.r, 'missing|negative|without_claims|without_day_supply|without_beneficiaries|ge65_exceeds_total') THEN 'DATA_QUALITY' ELSE 'BEHAVIOR_EVIDENCE' END)), ',') AS classes, "
    "CASE WHEN suppressed THEN 'suppression_context/INFO/CONTEXT' ELSE '' END AS context FROM pr_ruled",
)
def prescriber_inferred_classes(spark, sf_dir):
    df = ps.normalise_reasons(evaluated(spark, sf_dir))
    classes = F.array_join(F.transform("reasons", lambda e: F.concat(e["rule"], F.lit("="), e["category"])), ",")
    context = F.array_join(F.transform("context_reasons", lambda e: F.concat(e["rule"], F.lit("/"), e["severity"], F.lit("/"), e["category"])), ",")
    return df.select(*KEYS, classes.alias("classes"), context.alias("context"))


def _best(kind: str) -> str:
    return f"coalesce(list_max(list_transform(list_filter(e, lambda x: x.c = '{kind}'), lambda x: x.v)), 0)"


SCORED_SQL = (
    RULED_SQL + ",\npr_scored AS (SELECT *, CAST(round(CAST(1 - coalesce(list_product(list_transform(e, lambda x: 1 - x.v)), 1) AS DECIMAL(20,9)), 4) AS DOUBLE) AS rule_evidence_score, "
    f"{_best('HARD_ANOMALY')} AS hard_anomaly_score, {_best('DATA_QUALITY')} AS data_quality_score, {_best('BEHAVIOR_EVIDENCE')} AS behavior_evidence_score, len(e) > 0 AS rule_anomaly, "
    f"{_has('BEHAVIOR_EVIDENCE')} AS behavior_anomaly, {_has('DATA_QUALITY')} AS data_quality_issue FROM pr_ruled)"
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.score_evidence(ps.classify(evaluated(spark, sf_dir)))


@query(
    "prescriber_evidence_scores", "M1 M2",
    SCORED_SQL + f" SELECT {K}, rule_evidence_score, hard_anomaly_score, data_quality_score, behavior_evidence_score, CAST(0 AS DOUBLE) AS context_score, CAST(len(e) AS INT) AS evidence_count FROM pr_scored",
)
def prescriber_evidence_scores(spark, sf_dir):
    return scored(spark, sf_dir).select(
        *KEYS, "rule_evidence_score", "hard_anomaly_score", "data_quality_score", "behavior_evidence_score", "context_score", "evidence_count"
    )


# Stand-in model outputs with a plain formula, so that SQL can state the fusion.
_ISO = "least(1.0, greatest(0.0, coalesce(cost_per_claim, 0.0) / 60000.0))"
_CLU = "least(1.0, greatest(0.0, coalesce(tot_day_suply, 0.0) / 200.0))"
FUSED_SQL = (
    SCORED_SQL + f",\npr_models AS (SELECT *, {_ISO} AS isolation_score, {_ISO} >= 0.8 AS isolation_anomaly, {_CLU} AS cluster_score, {_CLU} >= 0.6 AS cluster_anomaly FROM pr_scored),\n"
    "pr_active AS (SELECT *, CAST(rule_anomaly AS INT) + CAST(isolation_anomaly AS INT) + CAST(cluster_anomaly AS INT) + CAST(behavior_anomaly AS INT) + CAST(data_quality_issue AS INT) AS active_sources, "
    "CASE WHEN rule_anomaly THEN rule_evidence_score ELSE 0 END + CASE WHEN isolation_anomaly THEN isolation_score ELSE 0 END + CASE WHEN cluster_anomaly THEN cluster_score ELSE 0 END "
    "+ CASE WHEN behavior_anomaly THEN behavior_evidence_score ELSE 0 END + CASE WHEN data_quality_issue THEN data_quality_score ELSE 0 END AS w FROM pr_models),\n"
    "pr_fused AS (SELECT *, active_sources >= 2 AS multi_source_anomaly, CAST(round(CAST(least(1.0, greatest(0.0, coalesce(w / nullif(active_sources, 0), 0.0))) AS DECIMAL(20,9)), 4) AS DOUBLE) AS fusion_score FROM pr_active)"
)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = scored(spark, sf_dir).withColumns({"isolation_score": F.expr(_ISO.replace("60000.0", "60000.0D")), "cluster_score": F.expr(_CLU.replace("200.0", "200.0D"))})
    flagged = models.withColumns({"isolation_anomaly": F.col("isolation_score") >= 0.8, "cluster_anomaly": F.col("cluster_score") >= 0.6})
    return ps.fuse(flagged)


@query(
    "prescriber_fusion", "M3 G12",
    FUSED_SQL + f" SELECT {K}, active_sources, multi_source_anomaly, fusion_score FROM pr_fused",
)
def prescriber_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select(*KEYS, "active_sources", "multi_source_anomaly", "fusion_score")


def _flags(df: DataFrame) -> dict:
    return {
        "ml_anomaly": F.col("isolation_anomaly"), "rule_anomaly": F.col("rule_anomaly"), "behavior_anomaly": F.col("behavior_anomaly"),
        "cluster_anomaly": F.col("cluster_anomaly"), "data_quality_issue": F.col("data_quality_issue"), "sla_risk": F.lit(False),
    }


@query(
    "prescriber_network_probability", "L11",
    FUSED_SQL + f" SELECT {K}, round(least(0.99, 0.01 + 0.98 * (0.25 * CAST(isolation_anomaly AS INT) + 0.2 * CAST(rule_anomaly AS INT) + 0.25 * CAST(behavior_anomaly AS INT) + 0.15 * CAST(cluster_anomaly AS INT) "
    "+ 0.05 * CAST(data_quality_issue AS INT)))::DOUBLE, 6) AS probability FROM pr_fused",
)
def prescriber_network_probability(spark, sf_dir):
    df = fused(spark, sf_dir)
    return df.select(*KEYS, F.round(ca.network_probability(_flags(df)), 6).alias("probability"))


_CAUSE_SQL = (
    "array_to_string(list_filter([CASE WHEN isolation_anomaly THEN 'multivariate_ml_anomaly:0.91' END, CASE WHEN rule_anomaly THEN 'rule_based_anomaly:0.75' END, "
    "CASE WHEN behavior_anomaly THEN 'historical_behavior_anomaly:0.75' END, CASE WHEN cluster_anomaly THEN 'unusual_peer_group_behavior:0.75' END, CASE WHEN data_quality_issue THEN 'data_quality_issue:0.65' END], lambda x: x IS NOT NULL), ',')"
)


@query("prescriber_lifted_causes", "L13 I7", FUSED_SQL + f" SELECT {K}, {_CAUSE_SQL} AS causes FROM pr_fused")
def prescriber_lifted_causes(spark, sf_dir):
    df = fused(spark, sf_dir)
    named = F.transform(ca.lifted_causes(_flags(df)), lambda c: F.concat(c["cause"], F.lit(":"), c["probability_given_anomaly"].cast("string")))
    return df.select(*KEYS, F.array_join(named, ",").alias("causes"))


DETECTED_SQL = "(rule_anomaly OR isolation_anomaly OR cluster_anomaly OR behavior_anomaly OR data_quality_issue OR multi_source_anomaly OR fusion_score >= 0.5)"


@query("prescriber_verdict", "M4", FUSED_SQL + f" SELECT {K}, {DETECTED_SQL} AS anomaly_detected, fusion_score FROM pr_fused")
def prescriber_verdict(spark, sf_dir):
    df = fused(spark, sf_dir)
    with_causes = df.withColumn("causes", ca.lifted_causes(_flags(df)))
    return ps.record_verdict(with_causes, F.size("causes")).select(*KEYS, "anomaly_detected", "fusion_score")


def _cause_items() -> str:
    out = []
    for kind in ("HARD_ANOMALY", "BEHAVIOR_EVIDENCE", "DATA_QUALITY"):
        for r, s, c, p in RULES:
            if c == kind:
                key = f"{r}_{s.lower()}" if r in dict(ps.CHANGE_RULES) else r
                cause, text = ps.ROOT_CAUSES.get(key, (r, f"Anomaly rule ''{r}'' was triggered."))
                out.append(f"CASE WHEN coalesce({p}, false) THEN '{cause}|{text}' END")
    return "list_filter([" + ", ".join(out) + "], lambda x: x IS NOT NULL)"


@query(
    "prescriber_root_causes", "N3",
    HISTORY_SQL + f",\nrc AS (SELECT {K}, {_cause_items()} AS c FROM pr_base), rc2 AS (SELECT {K}, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM rc) "
    f"SELECT {K}, array_to_string(list_transform(c, lambda x: split_part(x, '|', 1)), ',') AS causes, "
    "CASE WHEN len(c) > 0 THEN concat('Rule-based pharmacy anomaly evidence detected: ', array_to_string(list_transform(c, lambda x: split_part(x, '|', 2)), ' ')) ELSE '' END AS context_for_retrieval FROM rc2",
)
def prescriber_root_causes(spark, sf_dir):
    df = ps.root_causes(ps.classify(evaluated(spark, sf_dir)))
    return df.select(*KEYS, F.array_join("root_causes.cause", ",").alias("causes"), "context_for_retrieval")


@query(
    "prescriber_sla_breach", "P2",
    FUSED_SQL + ", n AS (SELECT (count(*) + 999) // 1000 AS batches FROM pr_fused), r AS (SELECT npi, brand, data_year, least(900 / 3600.0, 1.0)::DOUBLE AS workload_risk, "
    "(CASE WHEN batches > 1 THEN least(1.0, 0.1 * (batches - 1)) ELSE 0 END)::DOUBLE AS volume_risk, greatest(isolation_score, cluster_score) AS ml_risk, data_quality_score AS quality_risk, "
    "greatest(rule_evidence_score, behavior_evidence_score) AS evidence_risk FROM pr_fused, n), p AS (SELECT *, least(1.0, greatest(0.0, 0.25 * workload_risk + 0.2 * volume_risk + 0.2 * ml_risk + 0.2 * quality_risk + 0.15 * evidence_risk)) AS b FROM r) "
    f"SELECT {K}, CAST(round(CAST(workload_risk AS DECIMAL(20,9)), 4) AS DOUBLE) AS workload_risk, CAST(round(CAST(volume_risk AS DECIMAL(20,9)), 4) AS DOUBLE) AS volume_risk, CAST(round(CAST(ml_risk AS DECIMAL(20,9)), 4) AS DOUBLE) AS ml_risk, CAST(round(CAST(quality_risk AS DECIMAL(20,9)), 4) AS DOUBLE) AS quality_risk, CAST(round(CAST(evidence_risk AS DECIMAL(20,9)), 4) AS DOUBLE) AS evidence_risk, "
    "CAST(round(CAST(b AS DECIMAL(20,9)), 4) AS DOUBLE) AS breach_probability, b >= 0.5 AS sla_risk FROM p",
)
def prescriber_sla_breach(spark, sf_dir):
    df = sla.prescriber_breach(fused(spark, sf_dir), workload_seconds=900.0, batch_size=1000)
    return df.select(*KEYS, "workload_risk", "volume_risk", "ml_risk", "quality_risk", "evidence_risk", "breach_probability", "sla_risk")
