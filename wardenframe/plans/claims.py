"""Claims queries: features, rules, univariate outliers, integration, evidence and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.functions.columns import as_int
from wardenframe.operators import claims as cm
from wardenframe.operators import evidence as ev
from wardenframe.operators import outliers as ou
from wardenframe.operators import validation as va
from wardenframe.plans import views
from wardenframe.plans.registry import query
from wardenframe.session import materialise

K = "plan_id, issuer_id"


def _sum_sql(parts) -> str:
    some = " OR ".join(f"{p} IS NOT NULL" for p in parts)
    return f"CASE WHEN {some} THEN {' + '.join(f'coalesce({p}, 0.0)' for p in parts)} END"


TOTALS_SQL = "cf_totals AS (SELECT *, " + ", ".join(f"{_sum_sql(p)} AS {n}" for n, p in cm.TOTALS.items()) + " FROM plan_issuer)"


def _ratio_sql(name: str, n: str, d: str, upper: float) -> str:
    raw = f"(CASE WHEN {d} > 0 THEN {n} / {d} END)"
    outside = f"{raw} < 0" + ("" if upper == cm.UNBOUNDED else f" OR {raw} > {upper}")
    return (
        f"{raw} AS {name}_raw, CAST(coalesce({outside}, false) AS INT) AS {name}_invalid_flag, "
        f"CAST(({n} IS NULL OR {d} IS NULL OR coalesce({d} <= 0, false)) AS INT) AS {name}_missing_flag, "
        f"CASE WHEN NOT coalesce({outside}, false) THEN {raw} END AS {name}"
    )


def _nulls_sql(columns) -> str:
    return " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns)


FEATURES_SQL = (
    views.with_views("plan_issuer") + ",\n" + TOTALS_SQL + ",\ncf_wide AS (SELECT *, "
    + ", ".join(_ratio_sql(*r) for r in cm.ALL_RATIOS) + ", "
    + ", ".join(f"CAST(coalesce({a} > {b}, false) AS INT) AS {n}" for n, a, b in cm.EXCEEDS) + ", "
    + ", ".join(f"{a} - {b} AS {n}" for n, a, b in cm.DIFFERENCES) + ", "
    + ", ".join(f"{_nulls_sql(c)} AS {n}" for n, c in cm.MISSING_GROUPS.items())
    + " FROM cf_totals),\nclaims_features AS (SELECT *, total_important_missing_count / "
    + f"{len(cm.MISSING_GROUPS['total_important_missing_count'])} AS important_missing_rate FROM cf_wide)"
)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.claims_features(views.plan_issuer(spark, sf_dir))


def _family(ratios) -> list[str]:
    return [f"{n}{suffix}" for n, *_ in ratios for suffix in ("_raw", "_invalid_flag", "_missing_flag", "")]


def _register_features(name: str, covers: str, columns: list[str]) -> None:
    @query(name, covers, FEATURES_SQL + f" SELECT {K}, {', '.join(columns)} FROM claims_features")
    def build(spark, sf_dir):
        return features(spark, sf_dir).select("plan_id", "issuer_id", *columns)


_register_features("claims_rate_features", "F3 F5", _family(cm.RATE_FEATURES))
_register_features("claims_row_totals", "F4", list(cm.TOTALS))
_register_features("claims_appeal_features", "F6", _family(cm.APPEAL_FEATURES))
_register_features("claims_denial_mix", "F7", list(cm.REASON_COUNTS) + _family(cm.REASON_FEATURES))
_register_features("claims_enrollment_ratios", "F8", _family(cm.ENROLLMENT_FEATURES))
_register_features("claims_volume_ratios", "F9", _family(cm.VOLUME_FEATURES))
_register_features("claims_exceeds_flags", "F10", [n for n, *_ in cm.EXCEEDS])
_register_features("claims_differences", "F11", [n for n, *_ in cm.DIFFERENCES])
_register_features("claims_missing_counts", "F12", [*cm.MISSING_GROUPS, "important_missing_rate"])

_TEXT_COUNTS = (*cm.ISSUER_COUNTS, *cm.PLAN_COUNTS, *cm.APPEALS, *cm.REASON_COUNTS, *cm.ENROLLMENT)


def _as_text(c: str, kind: str) -> str:
    return f"CASE WHEN {c} < 3 THEN '**' WHEN {c} < 5 THEN 'n/a' ELSE CAST(CAST({c} AS BIGINT) AS {kind}) END"


@query(
    "claims_suppressed_counts", "F13",
    views.with_views("plan_issuer") + ", t AS (SELECT plan_id, issuer_id, " + ", ".join(f"{_as_text(c, 'VARCHAR')} AS {c}" for c in _TEXT_COUNTS)
    + f" FROM plan_issuer) SELECT {K}, " + " + ".join(f"CAST(TRY_CAST({c} AS DOUBLE) IS NULL AS INT)" for c in _TEXT_COUNTS) + " AS suppressed_count FROM t",
)
def claims_suppressed_counts(spark, sf_dir):
    text = views.plan_issuer(spark, sf_dir).selectExpr("plan_id", "issuer_id", *[f"{_as_text(c, 'STRING')} AS {c}" for c in _TEXT_COUNTS])
    return text.select("plan_id", "issuer_id", cm.non_numeric_count(_TEXT_COUNTS).alias("suppressed_count"))


_CONSISTENCY = [n for n, *_ in cm.EXCEEDS]
_CLEAN = list(cm.BOUNDED_RATES)
_RAW = [f"{n}_raw" for n in cm.BOUNDED_RATES]


@query(
    "claims_feature_validation", "C18",
    FEATURES_SQL + " " + " UNION ALL ".join(
        [f"SELECT '{c}' AS column_name, 'clean_rate' AS kind, count(*) FILTER (NOT {c} BETWEEN 0 AND 1) AS hits, count(*) FILTER ({c} IS NULL) AS missing FROM claims_features" for c in _CLEAN]
        + [f"SELECT '{c}', 'raw_ratio', count(*) FILTER (NOT {c} BETWEEN 0 AND 1), count(*) FILTER ({c} IS NULL) FROM claims_features" for c in _RAW]
        + [f"SELECT '{c}', 'consistency', count(*) FILTER ({c} = 1), count(*) FILTER ({c} IS NULL) FROM claims_features" for c in _CONSISTENCY]
    ),
)
def claims_feature_validation(spark, sf_dir):
    return va.feature_validation(features(spark, sf_dir), _CLEAN, _RAW, _CONSISTENCY)


@query(
    "claims_most_missing_features", "C18",
    FEATURES_SQL + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 4) AS null_percent FROM claims_features" for c in _CLEAN
    ) + ") WHERE null_count > 0 ORDER BY null_count DESC, column_name LIMIT 15",
)
def claims_most_missing_features(spark, sf_dir):
    return va.most_missing(features(spark, sf_dir), _CLEAN)


# ---------------------------------------------------------------- rules

_RULES = [(f"{c} < 0", "NEGATIVE_CLAIM_COUNT", f"{c} contains a negative value", "CRITICAL") for c in (*cm.ISSUER_COUNTS, *cm.PLAN_COUNTS, *cm.REASON_COUNTS)]
_RULES += [(f"{c} = 1", name, text, "CRITICAL") for c, name, text in cm.EXCEEDS_RULES]
_RULES += [(f"({c} < 0 OR {c} > 100)", name, text, "CRITICAL") for c, name, text in cm.PERCENT_RULES]
_RULES += [
    ("avg_monthly_enrollment < 0", "NEGATIVE_ENROLLMENT", "Average monthly enrollment is negative", "CRITICAL"),
    ("avg_monthly_disenrollment < 0", "NEGATIVE_DISENROLLMENT", "Average monthly disenrollment is negative", "CRITICAL"),
    ("avg_monthly_disenrollment > avg_monthly_enrollment", "DISENROLLMENT_GT_ENROLLMENT", "Average monthly disenrollment exceeds average monthly enrollment", "HIGH"),
    ("important_missing_rate >= 0.5", "EXCESSIVE_IMPORTANT_MISSINGNESS", "At least 50% of important fields are missing", "MEDIUM"),
]


def _fired(k: int) -> str:
    return f"coalesce({_RULES[k][0]}, false)"


RULED_SQL = (
    FEATURES_SQL + ",\ncr_raw AS (SELECT *, " + " + ".join(f"CAST({_fired(i)} AS INT)" for i in range(len(_RULES))) + " AS rule_count, "
    + "concat_ws(';', " + ", ".join(f"CASE WHEN {_fired(i)} THEN '{r[1]}' END" for i, r in enumerate(_RULES)) + ") AS names, "
    + "concat_ws(';', " + ", ".join(f"CASE WHEN {_fired(i)} THEN '{r[2]}' END" for i, r in enumerate(_RULES)) + ") AS reasons, "
    + "CASE " + " ".join(
        "WHEN " + " OR ".join(_fired(i) for i, r in enumerate(_RULES) if r[3] == s) + f" THEN '{s}'" for s in ("CRITICAL", "HIGH", "MEDIUM")
    ) + " ELSE 'NONE' END AS rule_severity FROM claims_features),\n"
    "claims_ruled AS (SELECT *, rule_count > 0 AS rule_anomaly, CASE WHEN rule_count > 0 THEN names ELSE 'NONE' END AS rule_name, "
    "CASE WHEN rule_count > 0 THEN reasons ELSE 'No rule violation detected' END AS rule_reason FROM cr_raw)"
)
_RULE_COLUMNS = ("rule_anomaly", "rule_count", "rule_name", "rule_reason", "rule_severity")


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.apply_claims_rules(features(spark, sf_dir))


@query("claims_rules", "K4 K5", RULED_SQL + f" SELECT {K}, {', '.join(_RULE_COLUMNS)} FROM claims_ruled")
def claims_rules(spark, sf_dir):
    return ruled(spark, sf_dir).select("plan_id", "issuer_id", *_RULE_COLUMNS)


@query("claims_rule_breakdown", "H3", RULED_SQL + " SELECT rule, count(*) AS records FROM (SELECT unnest(string_split(rule_name, ';')) AS rule FROM claims_ruled WHERE rule_anomaly) GROUP BY rule")
def claims_rule_breakdown(spark, sf_dir):
    fired = ruled(spark, sf_dir).where("rule_anomaly").select(F.explode(F.split("rule_name", ";")).alias("rule"))
    return fired.groupBy("rule").agg(F.count(F.lit(1)).alias("records"))


@query(
    "claims_rule_totals", "H1 H2",
    RULED_SQL + " SELECT rule_severity, count(*) AS records, CAST(sum(count(*)) OVER () AS BIGINT) AS total_records, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM claims_ruled GROUP BY rule_severity",
)
def claims_rule_totals(spark, sf_dir):
    counted = ruled(spark, sf_dir).groupBy("rule_severity").agg(F.count(F.lit(1)).alias("records"))
    # Four severities at most, so the total over them is tiny.
    totals = counted.groupBy().agg(F.collect_list(F.struct("rule_severity", "records")).alias("s"), F.sum("records").alias("total_records"))
    return totals.select(F.explode("s").alias("r"), "total_records").select(
        "r.rule_severity", "r.records", "total_records", F.round(F.col("r.records") * 100.0 / F.col("total_records"), 4).alias("percent")
    )


_SIMPLE_NUMERIC = (*cm.ISSUER_COUNTS, *cm.PLAN_COUNTS, *cm.APPEALS, *cm.REASON_COUNTS, *cm.ENROLLMENT)
_SIMPLE = [("(" + " OR ".join(f"coalesce({c} < 0, false)" for c in _SIMPLE_NUMERIC) + ")", "Negative numeric value")]
_SIMPLE += [(f"coalesce({a} > {b}, false)", t) for a, b, t in cm.SIMPLE_COMPARISONS]
_SIMPLE += [(f"coalesce({c} < 0 OR {c} > 100, false)", t) for c, t in cm.SIMPLE_PERCENTS]
_MODEL = "coalesce(avg_monthly_enrollment > 1200, false)"


@query(
    "claims_simple_check", "K6",
    views.with_views("plan_issuer") + ", s AS (SELECT plan_id, issuer_id, (" + " OR ".join(p for p, _ in _SIMPLE) + ") AS rule_anomaly, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {p} THEN '{t}' END" for p, t in _SIMPLE) + f") AS rule_reason, {_MODEL} AS ml_anomaly FROM plan_issuer) "
    "SELECT *, rule_anomaly OR ml_anomaly AS final_anomaly, CASE WHEN rule_anomaly AND ml_anomaly THEN 'RULE + ML' WHEN rule_anomaly THEN 'RULE' WHEN ml_anomaly THEN 'ML' ELSE 'NORMAL' END AS anomaly_type, "
    "CASE WHEN rule_anomaly THEN 'HIGH' WHEN ml_anomaly THEN 'MEDIUM' ELSE 'NORMAL' END AS severity FROM s",
)
def claims_simple_check(spark, sf_dir):
    df = cm.simple_claims_check(views.plan_issuer(spark, sf_dir), _SIMPLE_NUMERIC, F.col("avg_monthly_enrollment") > 1200)
    return df.select("plan_id", "issuer_id", "rule_anomaly", "rule_reason", "ml_anomaly", "final_anomaly", "anomaly_type", "severity")


# ---------------------------------------------------------------- univariate statistics

#: Every numeric feature: counts, totals, ratios before and after their check, differences and gap counts.
STAT_FEATURES = (
    *cm.ISSUER_COUNTS, *cm.PLAN_COUNTS, *cm.APPEALS, "percent_internal_overturned", "percent_external_overturned", *cm.REASON_COUNTS, *cm.ENROLLMENT, *cm.TOTALS,
    *(f"{n}{suffix}" for n, *_ in cm.ALL_RATIOS for suffix in ("_raw", "")), *(n for n, *_ in cm.DIFFERENCES), *cm.MISSING_GROUPS, "important_missing_rate",
)


def _stat_sql() -> str:
    stats = ", ".join(
        f"count({c}) AS n{i}, avg({c}) AS m{i}, stddev_samp({c}) AS s{i}, quantile_cont({c}, [0.01, 0.25, 0.75, 0.99]) AS q{i}" for i, c in enumerate(STAT_FEATURES)
    )
    per = []
    for i, c in enumerate(STAT_FEATURES):
        spread = f"(q{i}[3] - q{i}[2])"
        per.append(f"coalesce(n{i} >= 20 AND s{i} > 0 AND abs(({c} - m{i}) / s{i}) >= 3, false) AS z{i}")
        per.append(f"coalesce(n{i} >= 20 AND {spread} > 1e-12 AND ({c} < q{i}[2] - 1.5 * {spread} OR {c} > q{i}[3] + 1.5 * {spread}), false) AS o{i}")
        per.append(f"coalesce(n{i} >= 20 AND {c} < q{i}[1], false) AS lo{i}")
        per.append(f"coalesce(n{i} >= 20 AND {c} > q{i}[4], false) AS hi{i}")
    rates = [c for c in STAT_FEATURES if any(w in c for w in ("rate", "percent"))]
    counts = [c for c in STAT_FEATURES if any(w in c for w in ("claims", "appeals", "enrollment", "disenrollment", "denied", "resubmitted"))]
    invalid = [(f"coalesce({c} < 0 OR {c} > 100, false)", c, "INVALID_RATE") for c in rates] + [(f"coalesce({c} < 0, false)", c, "INVALID_NEGATIVE") for c in counts]
    shown = {c: f"concat('{c}=', printf('%.4f', CAST(round({c}, 4) AS DOUBLE)))" for c in STAT_FEATURES}
    listed = [
        f"CASE WHEN z{i} THEN concat({shown[c]}, ' [Z=', printf('%.2f', round(({c} - m{i}) / s{i}, 2)), ']') WHEN o{i} THEN concat({shown[c]}, ' [IQR]') END"
        for i, c in enumerate(STAT_FEATURES)
    ] + [f"CASE WHEN {p} THEN concat({shown[c]}, ' [{m}]') END" for p, c, m in invalid]
    n = len(STAT_FEATURES)

    def plus(letter: str) -> str:
        return " + ".join(f"CAST({letter}{i} AS INT)" for i in range(n))

    return (
        FEATURES_SQL + f",\nst AS (SELECT {stats} FROM claims_features),\nfl AS (SELECT f.*, st.*, {', '.join(per)} FROM claims_features f, st),\n"
        f"ct AS (SELECT {K}, {plus('z')} AS z_outlier_count, {plus('o')} AS iqr_outlier_count, {plus('lo')} AS below_low_percentile, {plus('hi')} AS above_high_percentile, "
        + " + ".join(f"CAST({c} IS NULL AS INT)" for c in STAT_FEATURES) + " AS missing_count, " + " + ".join(f"CAST({p} AS INT)" for p, *_ in invalid)
        + f" AS invalid_count, concat_ws(' | ', {', '.join(listed)}) AS outlier_features FROM fl),\n"
        f"ct2 AS (SELECT *, z_outlier_count + iqr_outlier_count AS outlier_count, (z_outlier_count + iqr_outlier_count) / {n} AS outlier_ratio, missing_count / {n} AS missing_ratio, "
        "z_outlier_count + iqr_outlier_count + invalid_count AS total_quality_issues FROM ct),\n"
        "claims_statistics AS (SELECT *, CASE WHEN invalid_count > 0 OR outlier_count >= 5 OR outlier_ratio >= 0.1 THEN 'HIGH' WHEN outlier_count >= 2 OR outlier_ratio >= 0.03 THEN 'MEDIUM' "
        "WHEN missing_ratio >= 0.75 OR outlier_count = 1 THEN 'LOW' ELSE 'NORMAL' END AS statistical_severity FROM ct2)"
    )


STATS_SQL = _stat_sql()
_STAT_COLUMNS = (
    "z_outlier_count", "iqr_outlier_count", "below_low_percentile", "above_high_percentile", "missing_count", "invalid_count", "outlier_features",
    "outlier_count", "outlier_ratio", "missing_ratio", "total_quality_issues", "statistical_severity", "statistical_anomaly",
)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = features(spark, sf_dir).select("plan_id", "issuer_id", *STAT_FEATURES)
    return ou.detect(materialise(needed, "claims-statistics"), STAT_FEATURES, ("plan_id", "issuer_id"))


@query(
    "claims_statistical_outliers", "L1 L2 L3 L4 L5",
    STATS_SQL + f" SELECT {K}, {', '.join(_STAT_COLUMNS[:-1])}, statistical_severity <> 'NORMAL' AS statistical_anomaly FROM claims_statistics",
)
def claims_statistical_outliers(spark, sf_dir):
    return statistics(spark, sf_dir).select("plan_id", "issuer_id", *_STAT_COLUMNS)


@query(
    "claims_worst_statistical", "J2 J1",
    STATS_SQL + f" SELECT {K}, statistical_severity, total_quality_issues, outlier_count, missing_count FROM claims_statistics WHERE statistical_severity <> 'NORMAL' "
    "ORDER BY CASE statistical_severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, total_quality_issues DESC, outlier_count DESC, missing_count DESC, plan_id, issuer_id LIMIT 20",
)
def claims_worst_statistical(spark, sf_dir):
    from wardenframe.operators.serving import severity_priority

    df = statistics(spark, sf_dir).where("statistical_anomaly")
    order = [F.desc(severity_priority("statistical_severity")), F.desc("total_quality_issues"), F.desc("outlier_count"), F.desc("missing_count"), "plan_id", "issuer_id"]
    return df.orderBy(*order).limit(20).select("plan_id", "issuer_id", "statistical_severity", "total_quality_issues", "outlier_count", "missing_count")


_QUANTILE_COLUMN = "plan_overall_denial_rate_raw"
_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query(
    "claims_exact_quantiles", "H9",
    FEATURES_SQL + " SELECT p AS probability, round(q, 9) AS value FROM (SELECT unnest([" + ", ".join(str(p) for p in _PROBS)
    + f"]) AS p, unnest(quantile_cont({_QUANTILE_COLUMN}, [" + ", ".join(str(p) for p in _PROBS) + "])) AS q FROM claims_features)",
)
def claims_exact_quantiles(spark, sf_dir):
    from wardenframe.functions.quantiles import quantile_table

    table = quantile_table(features(spark, sf_dir), [_QUANTILE_COLUMN], _PROBS)
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in _PROBS]).alias("probability"), F.col("q").alias("value"))
    return table.select(F.explode(pairs).alias("r")).select("r.probability", F.round("r.value", 9).alias("value"))


# ---------------------------------------------------------------- integration

# A score table that is cheap to state in SQL: distance from an even denial share, flagged at its 95th percentile.
SCORES_SQL = (
    "sc0 AS (SELECT plan_id, issuer_id, abs(plan_denied_in_network - 0.5 * plan_received_in_network) AS score FROM claims_ruled),\n"
    "sc AS (SELECT s.*, CAST(score >= t AS INT) AS bayesian_anomaly FROM sc0 s, (SELECT quantile_cont(score, 0.95) AS t FROM sc0))"
)
_STAT_EVIDENCE = "SELECT plan_id, issuer_id, total_quality_issues AS evidence_count, statistical_severity AS evidence_severity FROM claims_statistics WHERE statistical_severity <> 'NORMAL'"
_STATS_TAIL = STATS_SQL[len(FEATURES_SQL):]
FINAL_SQL = (
    RULED_SQL + ",\n" + SCORES_SQL + _STATS_TAIL + f",\nevd AS ({_STAT_EVIDENCE}),\n"
    "mg AS (SELECT sc.plan_id, sc.issuer_id, sc.bayesian_anomaly, CAST(coalesce(r.rule_anomaly, false) AS INT) AS rule_anomaly, coalesce(r.rule_count, 0) AS rule_count, coalesce(r.rule_name, '') AS rule_name, "
    "coalesce(e.evidence_count, 0) AS evidence_count, coalesce(e.evidence_severity, '') AS evidence_severity "
    "FROM sc LEFT JOIN claims_ruled r ON r.plan_id = sc.plan_id AND r.issuer_id = sc.issuer_id LEFT JOIN evd e ON e.plan_id = sc.plan_id AND e.issuer_id = sc.issuer_id),\n"
    "fin AS (SELECT *, bayesian_anomaly + rule_anomaly + CAST(evidence_count > 0 AS INT) AS anomaly_signal_count FROM mg),\n"
    "claims_final AS (SELECT *, CAST(anomaly_signal_count > 0 AS INT) AS final_anomaly, CASE WHEN anomaly_signal_count >= 3 THEN 'CRITICAL' WHEN anomaly_signal_count = 2 THEN 'HIGH' WHEN anomaly_signal_count = 1 THEN 'MEDIUM' ELSE 'LOW' END AS final_severity, "
    "CASE WHEN anomaly_signal_count = 0 THEN 'None' ELSE concat_ws(', ', CASE WHEN bayesian_anomaly = 1 THEN 'Bayesian' END, CASE WHEN rule_anomaly = 1 THEN 'Rule' END, CASE WHEN evidence_count > 0 THEN 'ML_Evidence' END) END AS anomaly_signals FROM fin)"
)
_FINAL_COLUMNS = (
    "bayesian_anomaly", "rule_anomaly", "rule_count", "rule_name", "evidence_count", "evidence_severity", "anomaly_signal_count", "final_anomaly", "final_severity", "anomaly_signals",
)


def score_table(df: DataFrame) -> DataFrame:
    from wardenframe.functions.columns import with_scalars
    from wardenframe.functions.quantiles import quantile_row

    scored = df.select("plan_id", "issuer_id", F.abs(F.col("plan_denied_in_network") - 0.5 * F.col("plan_received_in_network")).alias("score"))
    marked = with_scalars(scored, quantile_row(scored, ["score"], {"t": 0.95}), "_t")
    return marked.select("plan_id", "issuer_id", as_int(F.col("score") >= F.col("_t.score__t")).alias("bayesian_anomaly"))


def final_claims(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> DataFrame:
    """Verdict from rules, statistics and ``scores`` (none: the table that SQL can state)."""
    base = materialise(features(spark, sf_dir), "claims-features")  # scores, rules and statistics all read it
    rules = cm.apply_claims_rules(base).select("plan_id", "issuer_id", *_RULE_COLUMNS)
    found = ou.detect(base, STAT_FEATURES, ("plan_id", "issuer_id")).where("statistical_anomaly").select(
        "plan_id", "issuer_id", F.col("total_quality_issues").alias("evidence_count"), F.col("statistical_severity").alias("evidence_severity")
    )
    return cm.final_claims_verdict(cm.merge_signals(score_table(base) if scores is None else scores, rules, found))


@query("claims_signal_merge", "G5 M6", FINAL_SQL + f" SELECT {K}, {', '.join(_FINAL_COLUMNS)} FROM claims_final")
def claims_signal_merge(spark, sf_dir):
    return final_claims(spark, sf_dir).select("plan_id", "issuer_id", *_FINAL_COLUMNS)


@query(
    "claims_final_integrity", "C15",
    FINAL_SQL + " SELECT count(*) AS total_records, count(*) FILTER (final_anomaly = 1) AS final_anomalies, count(*) FILTER (bayesian_anomaly = 1) AS bayesian, count(*) FILTER (rule_anomaly = 1) AS rule, "
    "count(*) FILTER (evidence_count > 0) AS evidence, round(count(*) FILTER (final_anomaly = 1) * 100.0 / count(*), 4) AS final_anomaly_percentage, 'PASSED' AS status FROM claims_final",
)
def claims_final_integrity(spark, sf_dir):
    df = final_claims(spark, sf_dir).withColumn("final", F.col("final_anomaly") == 1)
    return va.fused_integrity(df, "final", {"bayesian": F.col("bayesian_anomaly") == 1, "rule": F.col("rule_anomaly") == 1, "evidence": F.col("evidence_count") > 0})


# ---------------------------------------------------------------- evidence and explanations

# The rates whose extremes count as evidence, in the order of their items.
EVIDENCE_RATES = (
    "issuer_in_network_denial_rate", "issuer_out_network_denial_rate", "issuer_overall_denial_rate",
    "plan_in_network_denial_rate", "plan_out_network_denial_rate", "plan_overall_denial_rate",
    "issuer_in_network_resubmission_rate", "issuer_out_network_resubmission_rate", "issuer_overall_resubmission_rate",
    "plan_in_network_resubmission_rate", "plan_out_network_resubmission_rate", "plan_overall_resubmission_rate",
    "internal_overturn_rate", "external_overturn_rate", "overall_overturn_rate",
    *(f"{r}_denial_rate" for r in cm.REASONS), "disenrollment_rate",
)


def _evidence_sql() -> str:
    items = [(f"{c} = 1", "DATA_QUALITY_FLAG", c, f"'{c.replace('_', ' ')} is triggered.'") for c in _CONSISTENCY]
    items.append(("total_important_missing_count > 0", "MISSINGNESS", "total_important_missing_count", "concat(CAST(total_important_missing_count AS VARCHAR), ' important data fields are missing or unavailable.')"))
    items.append(("important_missing_rate >= 0.25", "MISSINGNESS", "important_missing_rate", "concat('Important missingness rate is ', printf('%.1f', round(important_missing_rate * 100, 1)), '%.')"))

    def num(v: str) -> str:
        return f"CASE WHEN abs({v}) >= 1 THEN printf('%.3f', round({v}, 3)) ELSE printf('%.4f', round({v}, 4)) END"

    for i, c in enumerate(EVIDENCE_RATES):
        text = c.replace("_", " ")
        items.append((f"{c} > b{i}[2]", "EXTREME_HIGH", c, f"concat('{text} = ', {num(c)}, ', above the dataset 99th percentile (', {num(f'b{i}[2]')}, ').')"))
        items.append((f"({c} < b{i}[1] AND NOT coalesce({c} > b{i}[2], false))", "EXTREME_LOW", c, f"concat('{text} = ', {num(c)}, ', below the dataset 1st percentile (', {num(f'b{i}[1]')}, ').')"))
    for c in EVIDENCE_RATES:
        items.append((f"{c}_invalid_flag = 1", "DATA_QUALITY_FLAG", f"{c}_invalid_flag", f"'{c.replace('_', ' ')} contains an invalid raw value.'"))
    array = "list_filter([" + ", ".join(
        f"CASE WHEN coalesce({p}, false) THEN {{'t': '{t}', 'f': '{f}', 'm': {m}}} END" for p, t, f, m in items
    ) + "], lambda x: x IS NOT NULL)"
    bounds = ", ".join(f"quantile_cont({c}, [0.01, 0.99]) AS b{i}" for i, c in enumerate(EVIDENCE_RATES))
    return (
        RULED_SQL + f",\nbd AS (SELECT {bounds} FROM claims_ruled),\nex AS (SELECT {K}, {array} AS e FROM claims_ruled, bd WHERE rule_anomaly),\n"
        "ex2 AS (SELECT *, list_transform(e, lambda x: x.t) AS ts, list_transform(e, lambda x: x.m) AS ms, list_transform(e, lambda x: x.f) AS fs, len(e) AS n FROM ex) "
        f"SELECT {K}, CAST(n AS INT) AS evidence_count, CASE WHEN list_contains(ts, 'DATA_QUALITY_FLAG') OR list_contains(ts, 'EXTREME_HIGH') THEN 'HIGH' "
        "WHEN list_contains(ts, 'EXTREME_LOW') OR list_contains(ts, 'MISSINGNESS') THEN 'MEDIUM' ELSE 'LOW' END AS evidence_severity, array_to_string(fs, ',') AS evidence_features, "
        "CASE WHEN n > 5 THEN concat(array_to_string(ms[1:5], ' '), ' ', CAST(n - 5 AS VARCHAR), ' additional evidence item(s).') ELSE array_to_string(ms, ' ') END AS evidence_summary, "
        "CAST(len(list_filter(ts, lambda x: x = 'DATA_QUALITY_FLAG')) AS INT) AS quality_flags FROM ex2"
    )


EVIDENCE_SQL = _evidence_sql()


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.generate_evidence(materialise(ruled(spark, sf_dir), "claims-ruled"), F.col("rule_anomaly"), _CONSISTENCY, EVIDENCE_RATES, ("plan_id", "issuer_id"))


@query("claims_evidence", "N1 G11", EVIDENCE_SQL)
def claims_evidence(spark, sf_dir):
    flags = F.coalesce(F.get_json_object("evidence_types", "$.DATA_QUALITY_FLAG").cast("int"), F.lit(0))
    return evidence(spark, sf_dir).select(
        "plan_id", "issuer_id", "evidence_count", "evidence_severity", "evidence_features", "evidence_summary", flags.alias("quality_flags")
    )


@query(
    "claims_evidence_type_totals", "H4",
    EVIDENCE_SQL.replace(f"SELECT {K}, CAST(n AS INT) AS evidence_count", f", fin AS (SELECT ts, {K}, CAST(n AS INT) AS evidence_count", 1).replace("FROM ex2", "FROM ex2)")
    + " SELECT evidence_type, count(*) AS items FROM (SELECT unnest(ts) AS evidence_type FROM fin) GROUP BY evidence_type",
)
def claims_evidence_type_totals(spark, sf_dir):
    """Totals read back from the JSON type counts."""
    parsed = evidence(spark, sf_dir).select(F.explode(F.from_json("evidence_types", "map<string,bigint>")).alias("evidence_type", "n"))
    return parsed.groupBy("evidence_type").agg(F.sum("n").alias("items"))


# Explained fields and their names in a sentence; denial reasons go by their column name.
_FIELDS = {
    "issuer_received_out_network": "out-of-network claims received",
    "issuer_received_in_network": "in-network claims received",
    "issuer_denied_out_network": "out-of-network denied claims",
    "issuer_denied_in_network": "in-network denied claims",
    "issuer_resubmitted_out_network": "out-of-network resubmitted claims",
    "issuer_resubmitted_in_network": "in-network resubmitted claims",
    "internal_appeals_filed": "internal appeals filed",
    "internal_overturned": "internal appeals overturned",
    "percent_internal_overturned": "internal appeal overturn percentage",
    "external_appeals_filed": "external appeals filed",
    "external_overturned": "external appeals overturned",
    "percent_external_overturned": "external appeal overturn percentage",
    "plan_received_out_network": "plan-level out-of-network claims received",
    "plan_received_in_network": "plan-level in-network claims received",
    "plan_denied_out_network": "plan-level out-of-network denied claims",
    "plan_denied_in_network": "plan-level in-network denied claims",
    "plan_resubmitted_out_network": "plan-level out-of-network resubmitted claims",
    "plan_resubmitted_in_network": "plan-level in-network resubmitted claims",
    **{c: c for c in cm.REASON_COUNTS},
    "avg_monthly_enrollment": "average monthly enrollment",
    "avg_monthly_disenrollment": "average monthly disenrollment",
}


def _explain_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(_FIELDS))
    items = ", ".join(
        f"CASE WHEN coalesce(s{i} > 0 AND abs(({c} - m{i}) / s{i}) >= 2, false) THEN {{'o': -round(abs(({c} - m{i}) / s{i}), 6), 'f': '{c}', 'l': '{t}', 'd': CASE WHEN {c} > m{i} THEN 'high' ELSE 'low' END}} END"
        for i, (c, t) in enumerate(_FIELDS.items())
    )
    none = "len(u) = 0"
    model = f"CASE WHEN {none} THEN '{ev.NO_FIELD_TEXT}' ELSE concat('{ev.PATTERN_TEXT}', array_to_string(list_transform(u, lambda x: concat(x.l, ' is unusually ', x.d)), '; '), '.') END"
    cause = f"CASE WHEN {none} THEN '{ev.NO_FIELD_CAUSE}' ELSE concat('{ev.FIELD_CAUSE[0]}', array_to_string(list_transform(u, lambda x: x.l)[1:3], ', '), '{ev.FIELD_CAUSE[1]}') END"

    def by_type(i: int, ml: str, rule: str | None = None, both: str | None = None) -> str:
        quoted = {k: f"'{t[i]}'" for k, t in ev.FIXED_TEXTS.items()}
        if rule:
            quoted["RULE"] = rule
        if both:
            quoted["RULE + ML"] = both
        return f"CASE anomaly_type WHEN 'ML' THEN {ml} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quoted.items()) + f" ELSE '{ev.OTHER_TEXTS[i]}' END"

    simple = claims_simple_sql()
    return (
        simple + f",\nms AS (SELECT {stats} FROM plan_issuer),\nuf AS (SELECT p.plan_id, p.issuer_id, list_sort(list_filter([{items}], lambda x: x IS NOT NULL))[1:5] AS u FROM plan_issuer p, ms),\n"
        f"j AS (SELECT sm.plan_id, sm.issuer_id, sm.anomaly_type, sm.rule_reason, uf.u FROM sm JOIN uf ON sm.plan_id = uf.plan_id AND sm.issuer_id = uf.issuer_id) "
        f"SELECT {K}, anomaly_type, array_to_string(list_transform(u, lambda x: x.f), ',') AS unusual_fields, "
        f"{by_type(0, model, 'rule_reason', f'concat(rule_reason, chr(46), chr(32), {model})')} AS explanation, {by_type(1, cause)} AS likely_cause, {by_type(2, chr(39) + ev.ML_FIX + chr(39))} AS recommended_fix FROM j"
    )


def claims_simple_sql() -> str:
    return (
        views.with_views("plan_issuer") + ", s AS (SELECT plan_id, issuer_id, (" + " OR ".join(p for p, _ in _SIMPLE) + ") AS rule_anomaly, concat_ws('; ', "
        + ", ".join(f"CASE WHEN {p} THEN '{t}' END" for p, t in _SIMPLE) + f") AS rule_reason, {_MODEL} AS ml_anomaly FROM plan_issuer), "
        "sm AS (SELECT *, CASE WHEN rule_anomaly AND ml_anomaly THEN 'RULE + ML' WHEN rule_anomaly THEN 'RULE' WHEN ml_anomaly THEN 'ML' ELSE 'NORMAL' END AS anomaly_type FROM s)"
    )


@query("claims_explanations", "N2 I5 G6", _explain_sql())
def claims_explanations(spark, sf_dir):
    base = views.plan_issuer(spark, sf_dir)
    typed = cm.simple_claims_check(base, _SIMPLE_NUMERIC, F.col("avg_monthly_enrollment") > 1200).select("plan_id", "issuer_id", "anomaly_type", "rule_reason")
    fields = ev.unusual_fields(base, _FIELDS, ("plan_id", "issuer_id"))
    explained = ev.explain(typed.join(fields, ["plan_id", "issuer_id"], "left"))
    return explained.select(
        "plan_id", "issuer_id", "anomaly_type", F.array_join("unusual.field", ",").alias("unusual_fields"), "explanation", "likely_cause", "recommended_fix"
    )

