"""Plan x issuer claims: ratio features, consistency flags, rules and the final claims verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import (
    any_of,
    as_int,
    flag,
    highest_severity,
    join_present,
    parse_bool,
    ratio_family,
    row_sum,
    to_number,
    total,
)
from wardenframe.operators.rules import Rule, evidence_array

KEYS = ("plan_id", "issuer_id")
UNBOUNDED = float("inf")

# Denial reasons, totals, ratios, flags and differences of the feature layout.
REASONS = (
    "referral_required", "out_of_network", "services_excluded", "medical_necessity", "behavioral_health_medical_necessity",
    "benefit_limit", "member_not_covered", "investigational_experimental_cosmetic", "administrative", "other",
)
ISSUER_COUNTS = (
    "issuer_received_out_network", "issuer_received_in_network", "issuer_denied_out_network", "issuer_denied_in_network",
    "issuer_resubmitted_out_network", "issuer_resubmitted_in_network",
)
PLAN_COUNTS = (
    "plan_received_out_network", "plan_received_in_network", "plan_denied_out_network", "plan_denied_in_network",
    "plan_resubmitted_out_network", "plan_resubmitted_in_network",
)
REASON_COUNTS = tuple(f"denied_{r}" for r in REASONS)
APPEALS = ("internal_appeals_filed", "internal_overturned", "external_appeals_filed", "external_overturned")
ENROLLMENT = ("avg_monthly_enrollment", "avg_monthly_disenrollment")
TOTALS = {
    "issuer_total_claims": ISSUER_COUNTS[0:2],
    "issuer_total_denied": ISSUER_COUNTS[2:4],
    "issuer_total_resubmitted": ISSUER_COUNTS[4:6],
    "plan_total_claims": PLAN_COUNTS[0:2],
    "plan_total_denied": PLAN_COUNTS[2:4],
    "plan_total_resubmitted": PLAN_COUNTS[4:6],
    "total_internal_appeals": ("internal_appeals_filed",),
    "total_external_appeals": ("external_appeals_filed",),
    "total_appeals": ("internal_appeals_filed", "external_appeals_filed"),
    "total_overturned": ("internal_overturned", "external_overturned"),
}
RATE_FEATURES = tuple(
    (f"{level}_{scope}_{kind}_rate", top, bottom, 1.0)
    for level in ("issuer", "plan")
    for kind, word in (("denial", "denied"), ("resubmission", "resubmitted"))
    for scope, top, bottom in (
        ("in_network", f"{level}_{word}_in_network", f"{level}_received_in_network"),
        ("out_network", f"{level}_{word}_out_network", f"{level}_received_out_network"),
        ("overall", f"{level}_total_{word}", f"{level}_total_claims"),
    )
) + tuple(
    (f"{level}_{scope}_claim_ratio", f"{level}_received_{scope}", f"{level}_total_claims", 1.0)
    for level in ("issuer", "plan")
    for scope in ("in_network", "out_network")
)
APPEAL_FEATURES = (
    ("internal_overturn_rate", "internal_overturned", "internal_appeals_filed", 1.0),
    ("external_overturn_rate", "external_overturned", "external_appeals_filed", 1.0),
    ("overall_overturn_rate", "total_overturned", "total_appeals", 1.0),
    ("internal_appeal_to_denial_rate", "total_internal_appeals", "issuer_total_denied", 1.0),
    ("external_appeal_to_denial_rate", "total_external_appeals", "issuer_total_denied", 1.0),
    ("total_appeal_to_denial_rate", "total_appeals", "issuer_total_denied", 1.0),
)
REASON_FEATURES = tuple((f"{r}_denial_rate", f"denied_{r}", "plan_total_denied", 1.0) for r in REASONS)
ENROLLMENT_FEATURES = (
    ("disenrollment_rate", "avg_monthly_disenrollment", "avg_monthly_enrollment", 1.0),
    ("claims_per_enrollee", "plan_total_claims", "avg_monthly_enrollment", UNBOUNDED),
    ("denied_claims_per_enrollee", "plan_total_denied", "avg_monthly_enrollment", UNBOUNDED),
    ("resubmitted_claims_per_enrollee", "plan_total_resubmitted", "avg_monthly_enrollment", UNBOUNDED),
)
VOLUME_FEATURES = (
    ("plan_to_issuer_claim_ratio", "plan_total_claims", "issuer_total_claims", UNBOUNDED),
    ("plan_to_issuer_denied_ratio", "plan_total_denied", "issuer_total_denied", UNBOUNDED),
)
EXCEEDS = (
    ("plan_denied_exceeds_received", "plan_total_denied", "plan_total_claims"),
    ("issuer_denied_exceeds_received", "issuer_total_denied", "issuer_total_claims"),
    ("plan_resubmitted_exceeds_received", "plan_total_resubmitted", "plan_total_claims"),
    ("issuer_resubmitted_exceeds_received", "issuer_total_resubmitted", "issuer_total_claims"),
    ("internal_overturned_exceeds_appeals", "internal_overturned", "internal_appeals_filed"),
    ("external_overturned_exceeds_appeals", "external_overturned", "external_appeals_filed"),
)
DIFFERENCES = (
    ("plan_received_minus_denied", "plan_total_claims", "plan_total_denied"),
    ("issuer_received_minus_denied", "issuer_total_claims", "issuer_total_denied"),
    ("plan_received_minus_resubmitted", "plan_total_claims", "plan_total_resubmitted"),
    ("issuer_received_minus_resubmitted", "issuer_total_claims", "issuer_total_resubmitted"),
)
MISSING_GROUPS = {
    "issuer_claims_missing_count": ISSUER_COUNTS,
    "plan_claims_missing_count": PLAN_COUNTS,
    "appeal_missing_count": APPEALS,
    "enrollment_missing_count": ENROLLMENT,
    "total_important_missing_count": ISSUER_COUNTS + PLAN_COUNTS + APPEALS + ENROLLMENT + REASON_COUNTS,
}
ALL_RATIOS = RATE_FEATURES + APPEAL_FEATURES + REASON_FEATURES + ENROLLMENT_FEATURES + VOLUME_FEATURES
BOUNDED_RATES = tuple(n for n, _, _, upper in ALL_RATIOS if upper == 1.0 and n.endswith("_rate"))


def add_totals(df: DataFrame) -> DataFrame:
    return df.select("*", *[row_sum(parts).alias(name) for name, parts in TOTALS.items()])


def add_ratios(df: DataFrame, ratios: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Four columns per ratio, all in one projection."""
    return df.select("*", *[c for name, n, d, upper in ratios for c in ratio_family(name, n, d, upper)])


def claims_features(df: DataFrame) -> DataFrame:
    """The whole feature layout in three projections: totals, then ratios and flags, then rates of gaps."""
    wide = add_totals(df)
    wide = wide.select(
        "*",
        *[c for name, n, d, upper in ALL_RATIOS for c in ratio_family(name, n, d, upper)],
        *[F.expr(f"int(coalesce({a} > {b}, false)) AS {name}") for name, a, b in EXCEEDS],
        *[F.expr(f"{a} - {b} AS {name}") for name, a, b in DIFFERENCES],
        *[F.expr(" + ".join(f"int({c} IS NULL)" for c in cols) + f" AS {name}") for name, cols in MISSING_GROUPS.items()],
    )
    share = F.col("total_important_missing_count") / len(MISSING_GROUPS["total_important_missing_count"])
    return wide.withColumn("important_missing_rate", share)


def non_numeric_count(columns: Sequence[str]) -> Column:
    """Cells of a row that are missing, suppressed or no number."""
    return total(to_number(c).isNull().cast("int") for c in columns)


# ---------------------------------------------------------------- rules

# Severities from weak to strong, rule names and texts.
SEVERITIES = ("NONE", "MEDIUM", "HIGH", "CRITICAL")
EXCEEDS_RULES = (
    ("plan_denied_exceeds_received", "PLAN_DENIED_GT_RECEIVED", "Plan denied claims exceed plan received claims"),
    ("issuer_denied_exceeds_received", "ISSUER_DENIED_GT_RECEIVED", "Issuer denied claims exceed issuer received claims"),
    ("plan_resubmitted_exceeds_received", "PLAN_RESUBMITTED_GT_RECEIVED", "Plan resubmitted claims exceed plan received claims"),
    ("issuer_resubmitted_exceeds_received", "ISSUER_RESUBMITTED_GT_RECEIVED", "Issuer resubmitted claims exceed issuer received claims"),
    ("internal_overturned_exceeds_appeals", "INTERNAL_OVERTURNED_GT_APPEALS", "Internal overturned appeals exceed internal appeals filed"),
    ("external_overturned_exceeds_appeals", "EXTERNAL_OVERTURNED_GT_APPEALS", "External overturned appeals exceed external appeals filed"),
)
PERCENT_RULES = (
    ("percent_internal_overturned", "INVALID_INTERNAL_APPEAL_PERCENTAGE", "Internal appeal overturn percentage is outside 0 to 100"),
    ("percent_external_overturned", "INVALID_EXTERNAL_APPEAL_PERCENTAGE", "External appeal overturn percentage is outside 0 to 100"),
)
NO_RULE_NAME, NO_RULE_TEXT = "NONE", "No rule violation detected"


def claims_rules(columns: Sequence[str]) -> list[Rule]:
    """Rules that apply to the columns at hand, in evaluation order."""
    have = set(columns)
    rules = [
        Rule("NEGATIVE_CLAIM_COUNT", "CRITICAL", f"{c} contains a negative value", F.col(c) < 0, F.col(c), column=c)
        for c in (*ISSUER_COUNTS, *PLAN_COUNTS, *REASON_COUNTS)
        if c in have
    ]
    rules += [Rule(name, "CRITICAL", text, parse_bool(c)) for c, name, text in EXCEEDS_RULES if c in have]
    rules += [Rule(name, "CRITICAL", text, ~F.col(c).between(0, 100)) for c, name, text in PERCENT_RULES if c in have]
    enrolled, left = F.col("avg_monthly_enrollment"), F.col("avg_monthly_disenrollment")
    rules += [
        Rule("NEGATIVE_ENROLLMENT", "CRITICAL", "Average monthly enrollment is negative", enrolled < 0),
        Rule("NEGATIVE_DISENROLLMENT", "CRITICAL", "Average monthly disenrollment is negative", left < 0),
        Rule("DISENROLLMENT_GT_ENROLLMENT", "HIGH", "Average monthly disenrollment exceeds average monthly enrollment", left > enrolled),
    ]
    if "important_missing_rate" in have:
        rules.append(Rule("EXCESSIVE_IMPORTANT_MISSINGNESS", "MEDIUM", "At least 50% of important fields are missing", F.col("important_missing_rate") >= 0.5))
    if "suppressed_count" in have:
        rules.append(Rule("EXCESSIVE_SUPPRESSED_VALUES", "MEDIUM", "Record contains 10 or more suppressed or non-numeric values", F.col("suppressed_count") >= 10))
    return rules


def apply_claims_rules(df: DataFrame) -> DataFrame:
    """Anomaly flag, count, joined names and reasons, strongest severity."""
    found = df.withColumn("_evidence", evidence_array(claims_rules(df.columns)))
    fired = F.size("_evidence") > 0
    return found.select(
        *df.columns,
        fired.alias("rule_anomaly"),
        F.size("_evidence").alias("rule_count"),
        F.when(fired, F.array_join("_evidence.rule", ";")).otherwise(NO_RULE_NAME).alias("rule_name"),
        F.when(fired, F.array_join("_evidence.reason", ";")).otherwise(NO_RULE_TEXT).alias("rule_reason"),
        highest_severity(F.col("_evidence.severity"), SEVERITIES).alias("rule_severity"),
    )


# The shorter claims check, text per comparison.
SIMPLE_COMPARISONS = (
    ("issuer_denied_in_network", "issuer_received_in_network", "Issuer denied claims exceed received claims"),
    ("issuer_denied_out_network", "issuer_received_out_network", "Issuer out-of-network denied claims exceed received claims"),
    ("issuer_resubmitted_in_network", "issuer_received_in_network", "Issuer resubmitted claims exceed received claims"),
    ("issuer_resubmitted_out_network", "issuer_received_out_network", "Issuer out-of-network resubmitted claims exceed received claims"),
    ("internal_overturned", "internal_appeals_filed", "Internal overturned appeals exceed appeals filed"),
    ("external_overturned", "external_appeals_filed", "External overturned appeals exceed appeals filed"),
)
SIMPLE_PERCENTS = (
    ("percent_internal_overturned", "Invalid internal appeal percentage"),
    ("percent_external_overturned", "Invalid external appeal percentage"),
)


def simple_claims_check(df: DataFrame, numeric: Sequence[str], ml_flag: Column) -> DataFrame:
    """Nine simple rules fused with a model flag into type and severity."""
    checks = [(any_of(flag(F.col(c) < 0) for c in numeric), "Negative numeric value")]
    checks += [(flag(F.col(a) > F.col(b)), text) for a, b, text in SIMPLE_COMPARISONS]
    checks += [(flag(~F.col(c).between(0, 100)), text) for c, text in SIMPLE_PERCENTS]
    marked = df.select("*", any_of(p for p, _ in checks).alias("rule_anomaly"), join_present("; ", checks).alias("rule_reason"), flag(ml_flag).alias("ml_anomaly"))
    rule, model = F.col("rule_anomaly"), F.col("ml_anomaly")
    return marked.select(
        "*",
        (rule | model).alias("final_anomaly"),
        F.when(rule & model, "RULE + ML").when(rule, "RULE").when(model, "ML").otherwise("NORMAL").alias("anomaly_type"),
        F.when(rule, "HIGH").when(model, "MEDIUM").otherwise("NORMAL").alias("severity"),
    )


# ---------------------------------------------------------------- integration


def unique_rows(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` if no key occurs twice; raises when it is read otherwise."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    checked = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit(f"repeated key in {what}")).cast(packed.schema["_r"].dataType))
    return packed.select(*keys, checked.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def merge_signals(scores: DataFrame, rules: DataFrame, evidence: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left-join rule and evidence results to the scores, with neutral values where a side is absent.

    A key that occurs twice on any side raises, so no row can fan out.
    """
    sides = [unique_rows(df, keys, what) for df, what in ((scores, "scores"), (rules, "rules"), (evidence, "evidence"))]
    joined = sides[0].join(sides[1], list(keys), "left").join(sides[2], list(keys), "left")
    texts = ("rule_name", "rule_reason", "rule_severity", "evidence_severity", "evidence_summary")
    return joined.select(
        *scores.columns,
        as_int(F.col("rule_anomaly")).alias("rule_anomaly"),
        F.coalesce("rule_count", F.lit(0)).alias("rule_count"),
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        *[F.coalesce(t, F.lit("")).alias(t) for t in texts if t in joined.columns],
    )


def final_claims_verdict(merged: DataFrame) -> DataFrame:
    """Anomaly when any signal is on; severity and text by the number of signals."""
    gaussian, rule = F.col("bayesian_anomaly") == 1, F.col("rule_anomaly") == 1
    evidence = F.col("evidence_count") > 0
    signals = [(gaussian, "Bayesian"), (rule, "Rule"), (evidence, "ML_Evidence")]
    counted = merged.withColumn("anomaly_signal_count", total(as_int(p) for p, _ in signals))
    n = F.col("anomaly_signal_count")
    text = join_present(", ", [(flag(p), t) for p, t in signals])
    return counted.select(
        "*",
        (n > 0).cast("int").alias("final_anomaly"),
        F.when(n >= 3, "CRITICAL").when(n == 2, "HIGH").when(n == 1, "MEDIUM").otherwise("LOW").alias("final_severity"),
        F.when(n == 0, "None").otherwise(text).alias("anomaly_signals"),
    )
