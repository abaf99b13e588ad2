"""Fusion, verdict, risk and text queries whose scores come from fitted models.

The queries of the same names without the ending state a score by a plain formula, so that SQL can say what
follows from it. Here forest, clusters and Gaussian score are fitted and joined by business key; models have no SQL form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.functions.columns import with_scalars
from wardenframe.operators import authorization as au
from wardenframe.operators import causes as ca
from wardenframe.operators import claims as cm
from wardenframe.operators import cleaning as cl
from wardenframe.operators import clusters as cu
from wardenframe.operators import forest as fo
from wardenframe.operators import pharmacy as ph
from wardenframe.operators import prescriber as ps
from wardenframe.operators import sla
from wardenframe.plans import authorization, claims, models, pharmacy, prescriber, views
from wardenframe.plans.registry import query
from wardenframe.session import materialise

FOREST, CLUSTERS = "Isolation Forest", "K-Means"
#: Distance to the own centre from which on a record counts as unusual among its peers.
CLUSTER_QUANTILE = 0.99
PRESCRIBER_FEATURES = (
    "tot_clms", "tot_30day_fills", "tot_day_suply", "tot_drug_cst", "tot_benes", "ge65_tot_clms",
    *(name for name, *_ in ph.BEHAVIOUR_RATIOS), *ps.HISTORY_METRICS, "cost_per_claim_change",
)
PHARMACY_FEATURES = (
    "tot_clms", "tot_30day_fills", "tot_day_suply", "tot_drug_cst", "tot_benes", *(name for name, *_ in ph.GUARDED_RATIOS), *(name for name, _ in ph.YEAR_CHANGES),
)
AUTH_CATEGORIES = ("authorization_type_text", "approval_status_text", "service_description_text", "service_code_prefix")
AUTH_FEATURES = (
    "missing_critical_count", "invalid_date_count", "approval_delay_days", "validity_duration_days", "request_to_valid_days", "quantity", "amount",
    "patient_id_missing_flag", *(f"{c}_code" for c in AUTH_CATEGORIES),
)


def model_rows(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, scale: Callable[[DataFrame, Sequence[str]], DataFrame]
) -> tuple[DataFrame, DataFrame, list[str]]:
    """``df`` written once, its filled and scaled features (distinct rows, also written once), and the key that joins results back.

    The key is the business key with a name of the features, so rows that repeat a key neither fan out nor share a score.
    """
    named = materialise(df.withColumn("_row", F.xxhash64(*[F.col(c).cast("double") for c in features])), label)
    names = [*keys, "_row"]
    distinct = named.select(*names, *[F.col(c).cast("double").alias(c) for c in features]).dropDuplicates(names)
    values = materialise(distinct, f"{label}-features")  # the medians take several passes; what follows them is a projection
    return named, scale(cl.impute(values, features, cl.fit_medians(values, features)), features), names


def with_forest(df: DataFrame, keys: Sequence[str], features: Sequence[str], setup: str, label: str, scale=cl.robust_scale) -> DataFrame:
    """``df`` with ``ml_model`` and the forest's score, flag, scaled score and severity."""
    named, ready, names = model_rows(df, keys, features, label, scale)
    trees, contamination = fo.SETUPS[setup]
    found = fo.detect(ready, names, features, trees=trees, contamination=contamination).select(
        *names, F.col("anomaly_score").alias("ml_anomaly_score"), F.col("is_anomaly").alias("ml_anomaly"),
        F.col("normalised_score").alias("ml_normalised_score"), F.col("severity").alias("ml_anomaly_severity"), F.lit(FOREST).alias("ml_model"),
    )
    return named.join(found, names).drop("_row")


def with_forest_and_clusters(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """``df`` with flag, score and model name of forest and clusters."""
    named, ready, names = model_rows(df, keys, features, label, cl.standard_scale)
    trees, contamination = fo.SETUPS["prescriber"]
    forest = fo.detect(ready, names, features, trees=trees, contamination=contamination).select(
        *names, F.col("is_anomaly").alias("isolation_anomaly"), F.col("normalised_score").alias("isolation_score"), F.lit(FOREST).alias("isolation_model")
    )
    groups = cu.assign(ready, cu.fit_clusters(ready, features), features, names, anomaly_quantile=CLUSTER_QUANTILE).select(
        *names, "cluster_anomaly", F.col("cluster_anomaly_score").alias("cluster_score"), F.lit(CLUSTERS).alias("cluster_model")
    )
    return named.join(cu.join_model_results(forest, groups, names), names).drop("_row")


# ---------------------------------------------------------------- prescribers


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = prescriber.scored(spark, sf_dir).drop("reasons", "context_reasons", "evidence")  # their texts, once scored, are not read again
    return ps.fuse(with_forest_and_clusters(scored, prescriber.KEYS, PRESCRIBER_FEATURES, "prescriber-scored"))


_SIGNALS = ("isolation_model", "isolation_anomaly", "isolation_score", "cluster_model", "cluster_anomaly", "cluster_score")


@query("prescriber_fusion_by_models", "M3 G12")
def prescriber_fusion_by_models(spark, sf_dir):
    return fused(spark, sf_dir).select(*prescriber.KEYS, *_SIGNALS, "active_sources", "multi_source_anomaly", "fusion_score")


@query("prescriber_network_probability_by_models", "L11")
def prescriber_network_probability_by_models(spark, sf_dir):
    df = fused(spark, sf_dir)
    return df.select(*prescriber.KEYS, F.round(ca.network_probability(prescriber._flags(df)), 6).alias("probability"))


@query("prescriber_lifted_causes_by_models", "L13 I7")
def prescriber_lifted_causes_by_models(spark, sf_dir):
    df = fused(spark, sf_dir)
    named = F.transform(ca.lifted_causes(prescriber._flags(df)), lambda c: F.concat(c["cause"], F.lit(":"), c["probability_given_anomaly"].cast("string")))
    return df.select(*prescriber.KEYS, F.array_join(named, ",").alias("causes"))


@query("prescriber_verdict_by_models", "M4")
def prescriber_verdict_by_models(spark, sf_dir):
    df = fused(spark, sf_dir)
    with_causes = df.withColumn("causes", ca.lifted_causes(prescriber._flags(df)))
    return ps.record_verdict(with_causes, F.size("causes")).select(*prescriber.KEYS, "anomaly_detected", "fusion_score")


@query("prescriber_sla_breach_by_models", "P2")
def prescriber_sla_breach_by_models(spark, sf_dir):
    df = sla.prescriber_breach(fused(spark, sf_dir), workload_seconds=900.0, batch_size=1000)
    return df.select(*prescriber.KEYS, "workload_risk", "volume_risk", "ml_risk", "quality_risk", "evidence_risk", "breach_probability", "sla_risk")


# ---------------------------------------------------------------- pharmacy


@query("pharmacy_decision_sla_by_forest", "M5 P1")
def pharmacy_decision_sla_by_forest(spark, sf_dir):
    marked = with_forest(pharmacy.ruled(spark, sf_dir), ("npi", "brand", "data_year"), PHARMACY_FEATURES, "prescriber", "pharmacy-ruled", cl.standard_scale)
    return ph.sla_status(ph.decide(marked), pharmacy.TEST_TIERS).select(*pharmacy.DECISION_COLUMNS, *pharmacy.SLA_COLUMNS)


# ---------------------------------------------------------------- authorizations


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = authorization.ruled(spark, sf_dir)
    coded = cl.encode(df, AUTH_CATEGORIES, cl.fit_ordinals(df, AUTH_CATEGORIES))
    marked = with_forest(coded, ("authorization_id",), AUTH_FEATURES, "authorization", "auth-ruled")
    return marked.withColumn("ml_anomaly_flag", F.col("ml_anomaly").cast("int"))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialise(modelled(spark, sf_dir), "auth-modelled")  # read by the fit and by the result
    return ca.apply_cause_network(df, ca.fit_cause_network(df.withColumn("_y", F.col("ml_anomaly")), au.CAUSES, "_y"))


@query("auth_score_severity_by_forest", "L7")
def auth_score_severity_by_forest(spark, sf_dir):
    return modelled(spark, sf_dir).select("authorization_id", "ml_model", "ml_anomaly_score", "ml_anomaly_flag", "ml_anomaly_severity")


@query("auth_risk_by_forest", "M7")
def auth_risk_by_forest(spark, sf_dir):
    return au.risk(modelled(spark, sf_dir)).select("authorization_id", "risk_score", "risk_level", "risk_explanation")


@query("auth_final_flags_by_forest", "M8 L12")
def auth_final_flags_by_forest(spark, sf_dir):
    return au.final_flags(explained(spark, sf_dir)).select(
        "authorization_id", F.col("bayesian_anomaly_probability").alias("probability"), "final_anomaly_flag", "bayesian_anomaly_flag", "signals", "signal_count"
    )


@query("auth_model_texts_by_forest", "N4")
def auth_model_texts_by_forest(spark, sf_dir):
    return au.model_texts(explained(spark, sf_dir)).select(
        "authorization_id", "ml_evidence_count", "ml_evidence_severity", "ml_evidence_types", "ml_evidence_features", "ml_evidence_details", "ml_evidence_summary"
    )


# ---------------------------------------------------------------- claims


@query("claims_signal_merge_by_gaussian", "M6")
def claims_signal_merge_by_gaussian(spark, sf_dir):
    scores = models.plan_gaussian_scores(spark, sf_dir).select(*models.KEYS, "bayesian_anomaly")
    return claims.final_claims(spark, sf_dir, scores).select(*models.KEYS, *claims._FINAL_COLUMNS)


@query("plan_service_risk_by_forest", "L8 I5")
def plan_service_risk_by_forest(spark, sf_dir):
    service = models._SERVICE
    df = with_forest(views.plan_claims(spark, sf_dir), models.KEYS, service, "authorization", "plan-claims")
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in service for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}")) for c in service}
    contributing = fo.contributing_features(scaled, {c: F.col(c) for c in service})
    text = F.array_join(F.transform(contributing, lambda c: F.concat(c["feature"], F.lit(" "), c["direction"])), ", ")
    risk = with_scalars(df, stats, "_s").withColumn("anomaly_score", F.round(fo.risk_score(F.col("ml_anomaly_score")), 4))
    return risk.select(*models.KEYS, "ml_model", "anomaly_score", fo.risk_band(F.col("anomaly_score")).alias("severity"), text.alias("contributing_features"))
