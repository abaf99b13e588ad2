"""Authorization queries: features, rules, model severity, cause network, risk and texts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.functions.columns import with_scalars
from wardenframe.functions.quantiles import quantile_row
from wardenframe.operators import authorization as au
from wardenframe.operators import causes as ca
from wardenframe.plans import views
from wardenframe.plans.registry import query
from wardenframe.session import materialise

AS_OF = datetime.date(2000, 1, 1)
_RECORD = (
    "authorization_id", "patient_id", "provider_id", "request_date", "approval_date", "valid_from_date", "valid_to_date",
    "authorization_type", "service_code", "requested_quantity", "charged_amount", "approval_status",
)
_D = {c: f"TRY_CAST({c} AS DATE)" for c in au.DATE_COLUMNS}
_FEATURES = (
    "missing_critical_count", "invalid_date_count", "approval_delay_days", "validity_duration_days", "request_to_valid_days", "quantity", "amount",
    "patient_id_missing_flag", "authorization_type_text", "approval_status_text", "service_description_text", "service_code_prefix",
)

FEATURES_SQL = (
    views.with_views("auth_records") + ",\nau_features AS (SELECT *, " + " + ".join(f"CAST({c} IS NULL AS INT)" for c in au.CRITICAL_COLUMNS) + " AS missing_critical_count, "
    + " + ".join(f"CAST({c} IS NOT NULL AND {_D[c]} IS NULL AS INT)" for c in au.DATE_COLUMNS) + " AS invalid_date_count, "
    f"CAST(date_diff('day', {_D['request_date']}, {_D['approval_date']}) AS DOUBLE) AS approval_delay_days, CAST(date_diff('day', {_D['valid_from_date']}, {_D['valid_to_date']}) AS DOUBLE) AS validity_duration_days, "
    f"CAST(date_diff('day', {_D['request_date']}, {_D['valid_from_date']}) AS DOUBLE) AS request_to_valid_days, requested_quantity AS quantity, charged_amount AS amount, CAST(patient_id IS NULL AS INT) AS patient_id_missing_flag, "
    "trim(lower(authorization_type)) AS authorization_type_text, trim(lower(approval_status)) AS approval_status_text, '__MISSING__' AS service_description_text, regexp_extract(service_code, '^([A-Za-z]+)', 1) AS service_code_prefix FROM auth_records)"
)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.authorization_features(views.auth_records(spark, sf_dir))


@query("auth_features", "F14 D13 D16", FEATURES_SQL + f" SELECT authorization_id, {', '.join(_FEATURES)} FROM au_features")
def auth_features(spark, sf_dir):
    return features(spark, sf_dir).select("authorization_id", *_FEATURES)


@query(
    "provider_baselines", "F15 I9",
    FEATURES_SQL + ", m AS (SELECT provider_id, avg(approval_delay_days) AS a, avg(quantity) AS b FROM au_features GROUP BY provider_id) "
    "SELECT authorization_id, f.provider_id, round(a, 6) AS provider_avg_approval_delay_days, round(b, 6) AS provider_avg_quantity, round(approval_delay_days - a, 6) AS approval_delay_days_provider_deviation, round(quantity - b, 6) AS quantity_provider_deviation "
    "FROM au_features f LEFT JOIN m ON m.provider_id = f.provider_id",
)
def provider_baselines(spark, sf_dir):
    measures = ["approval_delay_days", "quantity"]
    df = au.provider_baseline(features(spark, sf_dir).select("authorization_id", "provider_id", *measures), "provider_id", measures)
    names = [f"provider_avg_{m}" for m in measures] + [f"{m}_provider_deviation" for m in measures]
    return df.select("authorization_id", "provider_id", *[F.round(n, 6).alias(n) for n in names])


_TESTS = {
    "missing_data": "missing_critical_count > 0",
    "invalid_date": "invalid_date_count > 0",
    "future_request": f"{_D['request_date']} > DATE '{AS_OF}'",
    "approval_before_request": f"{_D['approval_date']} < {_D['request_date']}",
    "invalid_validity_range": f"{_D['valid_to_date']} < {_D['valid_from_date']}",
    "negative_quantity": "quantity < 0",
    "negative_amount": "amount < 0",
    "unusual_quantity": "(quantity < q[1] - 1.5 * (q[2] - q[1]) OR quantity > q[2] + 1.5 * (q[2] - q[1]))",
    "unusual_amount": "(amount < a[1] - 1.5 * (a[2] - a[1]) OR amount > a[2] + 1.5 * (a[2] - a[1]))",
    "duplicate_record": "count(*) OVER (PARTITION BY " + ", ".join(_RECORD) + ") > 1",
}
RULED_SQL = (
    FEATURES_SQL + ",\nau_q AS (SELECT quantile_cont(quantity, [0.25, 0.75]) AS q, quantile_cont(amount, [0.25, 0.75]) AS a FROM au_features),\n"
    "au_flags AS (SELECT f.*, " + ", ".join(f"coalesce({p}, false) AS {c}" for c, p in _TESTS.items()) + " FROM au_features f, au_q),\n"
    "au_ruled AS (SELECT *, CAST(rule_anomaly_count > 0 AS INT) AS rule_anomaly_flag FROM (SELECT *, " + " + ".join(f"CAST({c} AS INT)" for c in au.CAUSES) + " AS rule_anomaly_count FROM au_flags))"
)


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    return au.run_rules(df, au.train_fences(df), AS_OF, _RECORD)


@query("auth_rules", "K7", RULED_SQL + f" SELECT authorization_id, {', '.join(au.CAUSES)}, rule_anomaly_count, rule_anomaly_flag FROM au_ruled")
def auth_rules(spark, sf_dir):
    return ruled(spark, sf_dir).select("authorization_id", *au.CAUSES, "rule_anomaly_count", "rule_anomaly_flag")


@query(
    "auth_rule_severity", "K10",
    RULED_SQL + " SELECT authorization_id, CASE WHEN rule_anomaly_count = 0 THEN 'NONE' WHEN rule_anomaly_count = 1 THEN 'LOW' WHEN rule_anomaly_count <= 3 THEN 'MEDIUM' ELSE 'HIGH' END AS rule_severity, "
    "CASE WHEN rule_anomaly_count = 0 THEN 'NONE' ELSE concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{c.upper()}' END" for c in au.CAUSES) + ") END AS rule_name, "
    "CASE WHEN rule_anomaly_count = 0 THEN 'No rule violation detected' ELSE concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in au.CAUSE_TEXTS.items()) + ") END AS rule_reason FROM au_ruled",
)
def auth_rule_severity(spark, sf_dir):
    return au.rule_texts(ruled(spark, sf_dir)).select("authorization_id", "rule_severity", "rule_name", "rule_reason")


# A model score with a plain formula, flagged at its 95th percentile, so that SQL can state what follows from it.
_SCORE = "abs(amount) / 250000.0 + abs(coalesce(approval_delay_days, 0) - 5) / 100.0"
MODEL_SQL = (
    RULED_SQL + f",\nau_s AS (SELECT *, {_SCORE} AS ml_anomaly_score FROM au_ruled),\nau_t AS (SELECT quantile_cont(ml_anomaly_score, [0.9, 0.95]) AS t FROM au_s),\n"
    "au_ml AS (SELECT s.*, CAST(ml_anomaly_score >= t[2] AS INT) AS ml_anomaly_flag, CASE WHEN ml_anomaly_score >= t[2] THEN 'HIGH' WHEN ml_anomaly_score >= t[1] THEN 'MEDIUM' ELSE 'LOW' END AS ml_anomaly_severity FROM au_s s, au_t)"
)


def with_model(df: DataFrame) -> DataFrame:
    """Severity of a score by its 90th and 95th percentile."""
    scored = df.withColumn("ml_anomaly_score", F.expr(_SCORE.replace("250000.0", "250000.0D").replace("100.0", "100.0D")))
    limits = quantile_row(scored, ["ml_anomaly_score"], {"medium": 0.90, "high": 0.95})
    wide = with_scalars(scored, limits, "_t")
    score, medium, high = F.col("ml_anomaly_score"), F.col("_t.ml_anomaly_score__medium"), F.col("_t.ml_anomaly_score__high")
    return wide.select(*scored.columns, (score >= high).cast("int").alias("ml_anomaly_flag"), au.score_severity(score, medium, high).alias("ml_anomaly_severity"))


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The percentiles of the score take several passes, each of which would look for duplicate records again.
    return with_model(materialise(ruled(spark, sf_dir), "auth-rules"))


@query("auth_score_severity", "L7", MODEL_SQL + " SELECT authorization_id, ml_anomaly_score, ml_anomaly_flag, ml_anomaly_severity FROM au_ml")
def auth_score_severity(spark, sf_dir):
    return modelled(spark, sf_dir).select("authorization_id", "ml_anomaly_score", "ml_anomaly_flag", "ml_anomaly_severity")


_MODEL_PART = "CASE WHEN ml_anomaly_flag = 1 THEN CASE ml_anomaly_severity WHEN 'HIGH' THEN 40 WHEN 'MEDIUM' THEN 30 ELSE 20 END ELSE 0 END"
_BONUS = "CASE WHEN rule_anomaly_flag = 1 AND ml_anomaly_flag = 1 THEN 10 ELSE 0 END"


@query(
    "auth_risk", "M7",
    MODEL_SQL + f", r AS (SELECT *, CAST(least(least(rule_anomaly_count * 15, 50) + {_MODEL_PART} + {_BONUS}, 100) AS INT) AS risk_score FROM au_ml) "
    "SELECT authorization_id, risk_score, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, "
    "CASE WHEN rule_anomaly_count = 0 AND ml_anomaly_flag = 0 THEN 'No anomaly signal detected' ELSE concat_ws('; ', CASE WHEN rule_anomaly_count > 0 THEN concat(CAST(rule_anomaly_count AS VARCHAR), ' rule violation(s)') END, "
    "CASE WHEN ml_anomaly_flag = 1 THEN concat('Isolation Forest anomaly (', ml_anomaly_severity, ')') END, CASE WHEN rule_anomaly_flag = 1 AND ml_anomaly_flag = 1 THEN 'Rule engine and ML both detected the anomaly' END) END AS risk_explanation FROM r",
)
def auth_risk(spark, sf_dir):
    return au.risk(modelled(spark, sf_dir)).select("authorization_id", "risk_score", "risk_level", "risk_explanation")


_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(au.CAUSES))
_K = len(au.CAUSES)
NETWORK_SQL = (
    MODEL_SQL + f",\nnw_rows AS (SELECT *, {_BITS} AS pattern FROM au_ml),\nnw_n AS (SELECT count(*) AS n, sum(ml_anomaly_flag) AS a, "
    + ", ".join(f"sum(CAST({c} AS INT)) AS y{i}" for i, c in enumerate(au.CAUSES)) + " FROM nw_rows),\n"
    "nw_prior AS (SELECT n, " + ", ".join(f"CASE WHEN y{i} = 0 THEN 0.0 WHEN y{i} = n THEN 1.0 ELSE (y{i} + 5.0) / (n + 10.0) END::DOUBLE AS p{i}" for i in range(_K))
    + ", pow(2, " + " + ".join(f"CAST(y{i} > 0 AND y{i} < n AS INT)" for i in range(_K)) + ") AS q FROM nw_n),\n"
    "nw_seen AS (SELECT pattern, count(*) AS n, sum(ml_anomaly_flag) AS a FROM nw_rows GROUP BY pattern),\n"
    "nw_all AS (SELECT g.p AS p, " + " * ".join(f"(CASE WHEN (g.p >> {i}) & 1 = 1 THEN p{i} ELSE 1 - p{i} END)" for i in range(_K))
    + " AS w, (coalesce(s.a, 0) + 10.0 / (2 * q)) / (coalesce(s.n, 0) + 10.0 / q) AS e "
    f"FROM (SELECT unnest(generate_series(0, {2 ** _K - 1})) AS p) g CROSS JOIN nw_prior LEFT JOIN nw_seen s ON s.pattern = g.p),\n"
    "nw_live AS (SELECT * FROM nw_all WHERE w > 0),\nnw_base AS (SELECT sum(w * e) AS b FROM nw_live),\n"
    "nw_act AS (SELECT s.pattern, CASE WHEN s.pattern = 0 OR coalesce(sum(l.w), 0) = 0 THEN any_value(b) ELSE sum(l.w * l.e) / sum(l.w) END AS prob FROM nw_seen s CROSS JOIN nw_base LEFT JOIN nw_live l ON (l.p & s.pattern) = s.pattern GROUP BY s.pattern)"
)


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialise(modelled(spark, sf_dir), "auth-modelled")  # read by the fit and by the result
    net = ca.fit_cause_network(df.withColumn("_y", F.col("ml_anomaly_flag") == 1), au.CAUSES, "_y")
    return ca.apply_cause_network(df, net)


@query(
    "auth_cause_network", "L12",
    NETWORK_SQL + " SELECT authorization_id, round(prob, 6) AS probability FROM nw_rows r JOIN nw_act a ON a.pattern = r.pattern",
)
def auth_cause_network(spark, sf_dir):
    return explained(spark, sf_dir).select("authorization_id", F.col("bayesian_anomaly_probability").alias("probability"))


_POST = "nw_post AS (SELECT " + ", ".join(f"(SELECT sum(w * e) FROM nw_live WHERE (p >> {i}) & 1 = 1) / b AS c{i}" for i in range(_K)) + " FROM nw_base)"
_TOP = (
    "list_sort(list_filter([" + ", ".join(
        f"CASE WHEN {c} THEN {{'o': -(CASE WHEN p{i} > 0 THEN coalesce(c{i}, 0) / p{i} ELSE 0 END), 's': -coalesce(c{i}, 0), 'n': '{c}'}} END" for i, c in enumerate(au.CAUSES)
    ) + "], lambda x: x IS NOT NULL))[1:3]"
)


@query(
    "auth_top_causes", "L12 I7",
    NETWORK_SQL + f", {_POST} SELECT authorization_id, array_to_string(list_transform({_TOP}, lambda x: x.n), ',') AS causes FROM nw_rows, nw_prior, nw_post",
)
def auth_top_causes(spark, sf_dir):
    return explained(spark, sf_dir).select("authorization_id", F.array_join("probable_root_causes.cause", ",").alias("causes"))


@query(
    "auth_final_flags", "M8",
    NETWORK_SQL + ", f AS (SELECT r.authorization_id, rule_anomaly_flag, ml_anomaly_flag, CAST(prob >= 0.5 AS INT) AS bayesian_anomaly_flag FROM nw_rows r JOIN nw_act a ON a.pattern = r.pattern) "
    "SELECT authorization_id, CAST(rule_anomaly_flag = 1 OR ml_anomaly_flag = 1 AS INT) AS final_anomaly_flag, bayesian_anomaly_flag, "
    "CASE WHEN rule_anomaly_flag + ml_anomaly_flag + bayesian_anomaly_flag = 0 THEN 'None' ELSE concat_ws(';', CASE WHEN rule_anomaly_flag = 1 THEN 'Rule' END, CASE WHEN ml_anomaly_flag = 1 THEN 'ML' END, CASE WHEN bayesian_anomaly_flag = 1 THEN 'Bayesian' END) END AS signals, "
    "rule_anomaly_flag + ml_anomaly_flag + bayesian_anomaly_flag AS signal_count FROM f",
)
def auth_final_flags(spark, sf_dir):
    return au.final_flags(explained(spark, sf_dir)).select("authorization_id", "final_anomaly_flag", "bayesian_anomaly_flag", "signals", "signal_count")


@query(
    "auth_model_texts", "N4",
    NETWORK_SQL + f", {_POST}, t AS (SELECT authorization_id, ml_anomaly_flag = 1 AS m, ml_anomaly_severity AS s, list_transform({_TOP}, lambda x: x.n) AS c FROM nw_rows, nw_prior, nw_post) "
    "SELECT authorization_id, CASE WHEN m THEN CAST(len(c) AS INT) ELSE 0 END AS ml_evidence_count, CASE WHEN m THEN s ELSE '' END AS ml_evidence_severity, CASE WHEN m THEN 'MULTIVARIATE_ANOMALY' ELSE '' END AS ml_evidence_types, "
    "CASE WHEN NOT m THEN '' WHEN len(c) = 0 THEN 'No configured rule cause identified' ELSE array_to_string(c, ';') END AS ml_evidence_features, "
    "CASE WHEN m THEN concat('Isolation Forest detected an unusual multivariate pattern with ', s, ' severity.') ELSE '' END AS ml_evidence_summary FROM t",
)
def auth_model_texts(spark, sf_dir):
    return au.model_texts(explained(spark, sf_dir)).select(
        "authorization_id", "ml_evidence_count", "ml_evidence_severity", "ml_evidence_types", "ml_evidence_features", "ml_evidence_summary"
    )
