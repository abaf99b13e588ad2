"""Model-based queries: forest, clusters, Gaussian score and service risk bands.

Models have no SQL form; they are compared with brute force in the tests. What follows from a score
is checked against SQL here and in the authorization queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenframe.functions.columns import with_scalars
from wardenframe.operators import cleaning as cl
from wardenframe.operators import clusters as cu
from wardenframe.operators import forest as fo
from wardenframe.operators import gaussian as ga
from wardenframe.plans import views
from wardenframe.plans.claims import STAT_FEATURES, features
from wardenframe.plans.registry import query
from wardenframe.session import materialise

KEYS = ("plan_id", "issuer_id")


def model_input(spark, sf_dir):
    """Filled features, written once: every model pass reads them several times."""
    df = materialise(features(spark, sf_dir).select(*KEYS, *STAT_FEATURES), "model-features")  # the medians take several passes
    return materialise(cl.impute(df, STAT_FEATURES, cl.fit_medians(df, STAT_FEATURES)), "model-input")


@query("plan_isolation_forest", "L6")
def plan_isolation_forest(spark, sf_dir):
    ready = cl.robust_scale(model_input(spark, sf_dir), STAT_FEATURES)
    trees, contamination = fo.SETUPS["claims_full"]
    return fo.detect(ready, KEYS, STAT_FEATURES, trees=trees, contamination=contamination)


@query("plan_peer_groups", "L9")
def plan_peer_groups(spark, sf_dir):
    ready = cl.standard_scale(model_input(spark, sf_dir), STAT_FEATURES)
    return cu.assign(ready, cu.fit_clusters(ready, STAT_FEATURES), STAT_FEATURES, KEYS)


@query("plan_peer_group_sizes", "H6")
def plan_peer_group_sizes(spark, sf_dir):
    return cu.cluster_sizes(plan_peer_groups(spark, sf_dir))


@query("plan_model_results_joined", "G12")
def plan_model_results_joined(spark, sf_dir):
    ready = cl.standard_scale(model_input(spark, sf_dir), STAT_FEATURES)
    trees, contamination = fo.SETUPS["prescriber"]
    forest = fo.detect(ready, KEYS, STAT_FEATURES, trees=trees, contamination=contamination)
    groups = cu.assign(ready, cu.fit_clusters(ready, STAT_FEATURES), STAT_FEATURES, KEYS, anomaly_quantile=0.99)
    return cu.join_model_results(forest, groups, KEYS)


@query("plan_gaussian_scores", "L10 D14 D15")
def plan_gaussian_scores(spark, sf_dir):
    filled = model_input(spark, sf_dir)
    kept = [c for c in cl.drop_sparse(filled, STAT_FEATURES).columns if c in STAT_FEATURES]
    scaled = cl.standard_scale(filled, kept)
    dropped = set(cl.correlated_columns(scaled, kept))
    return ga.detect(scaled, [c for c in kept if c not in dropped], KEYS)


_SERVICE = ("received_in_network", "resubmitted", "avg_monthly_disenrollment")
_Z = {c: f"(({c} - m_{c}) / s_{c})" for c in _SERVICE}
_SCORE = "({a} + {b}) / 8.0 - 0.25"
_LIST = (
    "list_sort(list_filter([" + ", ".join(
        f"CASE WHEN abs({_Z[c]}) >= 1 THEN {{'o': -round(abs({_Z[c]}), 3), 'p': {i}, 'f': '{c}', 'd': CASE WHEN {_Z[c]} > 0 THEN 'above_normal' ELSE 'below_normal' END}} END" for i, c in enumerate(_SERVICE)
    ) + "], lambda x: x IS NOT NULL))[1:5]"
)
RISK_SQL = (
    views.with_views("plan_claims") + ", st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SERVICE) + " FROM plan_claims), "
    f"r AS (SELECT plan_id, issuer_id, round(least(1.0, greatest(0.0, {_SCORE.format(a=_Z[_SERVICE[0]], b=_Z[_SERVICE[1]])} + 0.5)), 4) AS anomaly_score, {_LIST} AS l FROM plan_claims, st) "
    "SELECT plan_id, issuer_id, anomaly_score, CASE WHEN anomaly_score >= 0.75 THEN 'CRITICAL' WHEN anomaly_score >= 0.55 THEN 'HIGH' WHEN anomaly_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
    "array_to_string(list_transform(l, lambda x: concat(x.f, ' ', x.d)), ', ') AS contributing_features FROM r"
)


def service_risk(spark, sf_dir):
    df = views.plan_claims(spark, sf_dir)
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in _SERVICE for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = with_scalars(df, stats, "_s")
    scaled = {c: (F.col(c) - F.col(f"_s.m_{c}")) / F.col(f"_s.s_{c}") for c in _SERVICE}
    raw = (scaled[_SERVICE[0]] + scaled[_SERVICE[1]]) / 8.0 - 0.25
    return wide.select(
        *df.columns, F.round(fo.risk_score(raw), 4).alias("anomaly_score"),
        fo.contributing_features(scaled, {c: F.col(c) for c in _SERVICE}).alias("contributing"),
    ).withColumn("severity", fo.risk_band(F.col("anomaly_score")))


@query("plan_service_risk", "L8 I5", RISK_SQL)
def plan_service_risk(spark, sf_dir):
    text = F.array_join(F.transform("contributing", lambda c: F.concat(c["feature"], F.lit(" "), c["direction"])), ", ")
    return service_risk(spark, sf_dir).select("plan_id", "issuer_id", "anomaly_score", "severity", text.alias("contributing_features"))
