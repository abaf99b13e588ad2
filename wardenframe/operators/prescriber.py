"""Prescriber records: historical change, the wide rule set, evidence classes, scoring and fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import any_of, as_int, finite, flag, lookup, numeric_lookup, pin, plain_ratio, relative_change, round_decimal, total
from wardenframe.operators.rules import Rule, evidence_array, two_level, verdict_columns

# Change name and its metric.
HISTORY_METRICS = {
    "claim_volume_change": "tot_clms",
    "fill_volume_change": "tot_30day_fills",
    "days_supply_change": "tot_day_suply",
    "drug_cost_change": "tot_drug_cst",
    "beneficiary_change": "tot_benes",
}
# Default limits.
THRESHOLDS = {
    "drug_cost_change_high": 3.0, "drug_cost_change_medium": 1.5,
    "claim_volume_change_high": 2.0, "claim_volume_change_medium": 1.0,
    "fill_volume_change_high": 2.0, "fill_volume_change_medium": 1.0,
    "days_supply_change_high": 2.0, "days_supply_change_medium": 1.0,
    "beneficiary_change_high": 2.0, "beneficiary_change_medium": 1.0,
    "cost_per_claim_change_high": 2.0, "cost_per_claim_change_medium": 1.0,
    "cost_per_claim_high": 1000.0, "cost_per_claim_medium": 500.0,
    "cost_per_beneficiary_high": 5000.0, "cost_per_beneficiary_medium": 2500.0,
    "cost_per_day_supply_high": 100.0, "cost_per_day_supply_medium": 50.0,
    "day_supply_per_claim_high": 365.0, "day_supply_per_claim_medium": 180.0,
    "fills_per_claim_high": 5.0, "fills_per_claim_medium": 3.0,
    "claims_per_beneficiary_high": 20.0, "claims_per_beneficiary_medium": 10.0,
    "minimum_claims_for_ratio": 5.0, "minimum_beneficiaries_for_ratio": 2.0,
}
SEVERITIES = ("NONE", "LOW", "MEDIUM", "HIGH")
CRITICAL_COLUMNS = ("npi", "city", "state", "prescriber_type", "brand", "generic")
SIGNED_COLUMNS = (
    "tot_clms", "tot_30day_fills", "tot_day_suply", "tot_drug_cst", "tot_benes",
    "ge65_tot_clms", "ge65_tot_30day_fills", "ge65_tot_drug_cst", "ge65_tot_day_suply", "ge65_tot_benes",
)
# Ratio, activity column, its minimum (None: must be above 0), texts for HIGH and MEDIUM.
RATIO_RULES = (
    ("cost_per_claim", "tot_clms", "minimum_claims_for_ratio", ("Extremely high cost per claim", "Unusually high cost per claim")),
    ("cost_per_beneficiary", "tot_benes", "minimum_beneficiaries_for_ratio", ("Extremely high cost per beneficiary", "Unusually high cost per beneficiary")),
    ("cost_per_day_supply", "tot_day_suply", None, ("Extremely high drug cost per day supply", "Unusually high drug cost per day supply")),
    ("day_supply_per_claim", "tot_clms", "minimum_claims_for_ratio", ("Extremely high day supply per claim", "Unusually high day supply per claim")),
    ("fills_per_claim", "tot_clms", "minimum_claims_for_ratio", ("Extremely high fills per claim", "Unusually high fills per claim")),
    ("claims_per_beneficiary", "tot_benes", "minimum_beneficiaries_for_ratio", ("Extremely high claims per beneficiary", "Unusually high claims per beneficiary")),
)
CHANGE_RULES = (
    ("drug_cost_change", "Extreme year-over-year drug cost change"),
    ("claim_volume_change", "Extreme year-over-year claim volume change"),
    ("fill_volume_change", "Extreme year-over-year fill volume change"),
    ("days_supply_change", "Extreme year-over-year day supply change"),
    ("beneficiary_change", "Extreme year-over-year beneficiary change"),
    ("cost_per_claim_change", "Extreme year-over-year cost per claim change"),
)
SENIOR_RULES = (
    ("ge65_tot_clms", "tot_clms", "GE65 claims exceed total claims"),
    ("ge65_tot_30day_fills", "tot_30day_fills", "GE65 fills exceed total fills"),
    ("ge65_tot_drug_cst", "tot_drug_cst", "GE65 drug cost exceeds total drug cost"),
    ("ge65_tot_day_suply", "tot_day_suply", "GE65 day supply exceeds total day supply"),
    ("ge65_tot_benes", "tot_benes", "GE65 beneficiaries exceed total beneficiaries"),
)
SUPPRESSION_FLAGS = ("ge65_sprsn_flag", "ge65_bene_sprsn_flag")
NOT_SUPPRESSED = ("", "N", "NO", "0", "FALSE", "NONE", "NAN")


def exact_sum(c: str) -> Column:
    """Sum in decimals, so the result does not depend on the order of the rows; NULL when all are NULL."""
    return F.sum(F.col(c).cast("decimal(28,4)")).cast("double")


def history_change(current: DataFrame, historical: DataFrame, key: str = "npi") -> DataFrame:
    """Current records against the historical totals of their prescriber."""
    totals = historical.groupBy(key).agg(*[exact_sum(c).alias(f"historical_{c}") for c in HISTORY_METRICS.values()])
    joined = current.join(totals, key, "left")
    per_claim = plain_ratio("tot_drug_cst", "tot_clms")
    past = plain_ratio("historical_tot_drug_cst", "historical_tot_clms")
    return joined.select(
        "*",
        *[relative_change(c, f"historical_{c}", guarded=False).alias(n) for n, c in HISTORY_METRICS.items()],
        relative_change(per_claim, past, guarded=False).alias("cost_per_claim_change"),
    )


def prescriber_rules(columns: Sequence[str], thresholds: Mapping[str, float] | None = None) -> list[Rule]:
    """All checks whose columns are present, in evaluation order."""
    limits = {**THRESHOLDS, **(thresholds or {})}
    have = set(columns)

    def n(c: str) -> Column:
        return finite(F.col(c).cast("double"))

    critical = [c for c in CRITICAL_COLUMNS if c in have]
    rules = [Rule("missing_critical_value", "MEDIUM", "Critical field(s) are missing", any_of(F.col(c).isNull() for c in critical))]
    rules += [
        Rule("negative_value", "HIGH", f"Negative value detected in {c}", n(c) < 0, n(c), column=c) for c in SIGNED_COLUMNS if c in have
    ]
    rules += [
        Rule("fills_without_claims", "HIGH", "30-day fills exist while total claims are zero", (n("tot_clms") == 0) & (n("tot_30day_fills") > 0), n("tot_30day_fills")),
        Rule("claims_without_day_supply", "MEDIUM", "Claims exist but total day supply is zero", (n("tot_clms") > 0) & (n("tot_day_suply") == 0)),
        Rule("cost_without_claims", "HIGH", "Drug cost exists while claims are zero", (n("tot_clms") == 0) & (n("tot_drug_cst") > 0), n("tot_drug_cst")),
        Rule("claims_without_beneficiaries", "MEDIUM", "Claims exist but beneficiary count is zero", (n("tot_clms") > 0) & (n("tot_benes") == 0)),
    ]
    for ratio, activity, minimum, texts in RATIO_RULES:
        active = n(activity) > 0 if minimum is None else n(activity) >= limits[minimum]
        rules += two_level(ratio, n(ratio), limits[f"{ratio}_medium"], limits[f"{ratio}_high"], active, texts)
    for change, text in CHANGE_RULES:
        if change in have:
            rules += two_level(change, F.abs(n(change)), limits[f"{change}_medium"], limits[f"{change}_high"], F.lit(True), (text, text), level_in_name=False)
    rules += [
        Rule("ge65_exceeds_total", "HIGH", text, (n(a) >= 0) & (n(b) >= 0) & (n(a) > n(b)), n(a)) for a, b, text in SENIOR_RULES if a in have and b in have
    ]
    return rules


def suppression_context(columns: Sequence[str]) -> list[Rule]:
    """Suppression marks are context: they explain, but raise nothing."""
    return [
        Rule("suppression_context", "INFO", f"Suppression flag present in {c}", ~F.upper(F.trim(F.col(c).cast("string"))).isin(*NOT_SUPPRESSED), column=c)
        for c in SUPPRESSION_FLAGS
        if c in columns
    ]


def evaluate(df: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Add evidence, context and the rule verdict."""
    found = pin(
        df,
        evidence_array(prescriber_rules(df.columns, thresholds)).alias("reasons"),
        evidence_array(suppression_context(df.columns)).alias("context_reasons"),
    )
    return found.select("*", *verdict_columns(F.col("reasons"), SEVERITIES))


# ---------------------------------------------------------------- evidence classes

# Class of each rule.
RULE_CLASSES = {
    "negative_value": "HARD_ANOMALY",
    "fills_without_claims": "HARD_ANOMALY",
    "cost_without_claims": "HARD_ANOMALY",
    "ge65_exceeds_total": "HARD_ANOMALY",
    "cost_per_claim_medium": "BEHAVIOR_EVIDENCE",
    "cost_per_claim_high": "BEHAVIOR_EVIDENCE",
    "cost_per_beneficiary_medium": "BEHAVIOR_EVIDENCE",
    "cost_per_beneficiary_high": "BEHAVIOR_EVIDENCE",
    "cost_per_day_supply_medium": "BEHAVIOR_EVIDENCE",
    "cost_per_day_supply_high": "BEHAVIOR_EVIDENCE",
    "day_supply_per_claim_medium": "BEHAVIOR_EVIDENCE",
    "day_supply_per_claim_high": "BEHAVIOR_EVIDENCE",
    "fills_per_claim_medium": "BEHAVIOR_EVIDENCE",
    "fills_per_claim_high": "BEHAVIOR_EVIDENCE",
    "claims_per_beneficiary_medium": "BEHAVIOR_EVIDENCE",
    "claims_per_beneficiary_high": "BEHAVIOR_EVIDENCE",
    "drug_cost_change": "BEHAVIOR_EVIDENCE",
    "claim_volume_change": "BEHAVIOR_EVIDENCE",
    "fill_volume_change": "BEHAVIOR_EVIDENCE",
    "days_supply_change": "BEHAVIOR_EVIDENCE",
    "beneficiary_change": "BEHAVIOR_EVIDENCE",
    "cost_per_claim_change": "BEHAVIOR_EVIDENCE",
    "missing_critical_value": "DATA_QUALITY",
    "claims_without_day_supply": "DATA_QUALITY",
    "claims_without_beneficiaries": "DATA_QUALITY",
    "zero_cost_positive_claims": "DATA_QUALITY",
    "zero_beneficiaries_positive_claims": "DATA_QUALITY",
    "zero_day_supply_positive_claims": "DATA_QUALITY",
    "zero_fills_positive_claims": "DATA_QUALITY",
    "suppression_context": "CONTEXT",
}
CLASSES = ("HARD_ANOMALY", "DATA_QUALITY", "BEHAVIOR_EVIDENCE", "CONTEXT", "UNKNOWN")
# Words that reveal the class of an unlisted rule, tried in this order.
CLASS_WORDS = (
    ("drug_cost_change|claim_volume_change|fill_volume_change|days_supply_change|beneficiary_change|cost_per_claim_change", "BEHAVIOR_EVIDENCE"),
    ("missing|negative|without_claims|without_day_supply|without_beneficiaries|ge65_exceeds_total", "DATA_QUALITY"),
    ("cost_per_claim|cost_per_beneficiary|cost_per_day_supply|day_supply_per_claim|fills_per_claim|claims_per_beneficiary", "BEHAVIOR_EVIDENCE"),
)
# Score weights.
SEVERITY_WEIGHTS = {"HIGH": 0.75, "MEDIUM": 0.45, "LOW": 0.20, "INFO": 0.00}
CLASS_WEIGHTS = {"HARD_ANOMALY": 1.00, "DATA_QUALITY": 0.85, "BEHAVIOR_EVIDENCE": 0.65, "CONTEXT": 0.00, "UNKNOWN": 0.25}


def rule_class(rule: Column) -> Column:
    return lookup(RULE_CLASSES, rule, F.lit("UNKNOWN"))


def infer_class(rule: Column) -> Column:
    """Class by words in the rule name."""
    name = F.lower(F.coalesce(rule, F.lit("")))
    out = F.when(name == "", "UNKNOWN")
    for words, result in CLASS_WORDS:
        out = out.when(name.rlike(words), result)
    return out.otherwise("UNKNOWN")


def normalise_reasons(df: DataFrame) -> DataFrame:
    """Reasons with default severity and inferred class; context kept apart with its own class."""

    def reason(e: Column) -> Column:
        return F.struct(
            F.coalesce(e["rule"], F.lit("unknown")).alias("rule"), F.coalesce(e["severity"], F.lit("MEDIUM")).alias("severity"),
            F.coalesce(e["reason"], F.lit("")).alias("reason"), e["value"].alias("value"), e["threshold"].alias("threshold"),
            infer_class(e["rule"]).alias("category"),
        )

    def context(e: Column) -> Column:
        return F.struct(
            F.coalesce(e["rule"], F.lit("context")).alias("rule"), F.coalesce(e["severity"], F.lit("INFO")).alias("severity"),
            F.coalesce(e["reason"], F.lit("")).alias("reason"), F.lit("CONTEXT").alias("category"),
        )

    return df.withColumns({"reasons": F.transform("reasons", reason), "context_reasons": F.transform("context_reasons", context)})


def classify(df: DataFrame) -> DataFrame:
    """Add ``evidence``: reasons and context with class and score, and the class flags of the record."""
    everything = F.concat("reasons", "context_reasons")

    def scored(e: Column) -> Column:
        kind = rule_class(e["rule"])
        raw = numeric_lookup(SEVERITY_WEIGHTS, e["severity"], 0.0) * numeric_lookup(CLASS_WEIGHTS, kind, 0.25)
        return F.struct(
            e["rule"].alias("rule"), e["severity"].alias("severity"), e["reason"].alias("reason"), kind.alias("category"),
            F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4).alias("score"),
        )

    tagged = pin(df, F.transform(everything, scored).alias("evidence"))

    def has(kind: str) -> Column:
        return F.exists("evidence", lambda e: e["category"] == kind)

    return tagged.select(
        "*", has("HARD_ANOMALY").alias("hard_anomaly"), has("BEHAVIOR_EVIDENCE").alias("behavior_anomaly"),
        has("DATA_QUALITY").alias("data_quality_issue"), has("CONTEXT").alias("context_present"), F.size("evidence").alias("total_evidence"),
    )


def noisy_or(scores: Column) -> Column:
    """1 - product of (1 - score)."""
    return 1 - F.aggregate(scores, F.lit(1.0), lambda acc, s: acc * (1 - s))


def score_evidence(df: DataFrame) -> DataFrame:
    """Combined rule score without context, and the strongest score per class."""
    counted = F.filter("evidence", lambda e: e["category"] != "CONTEXT")

    def strongest(kind: str) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter("evidence", lambda e: e["category"] == kind), lambda e: e["score"])), F.lit(0.0))

    return pin(
        df,
        round_decimal(noisy_or(F.transform(counted, lambda e: e["score"])), 4).alias("rule_evidence_score"),
        strongest("HARD_ANOMALY").alias("hard_anomaly_score"),
        strongest("DATA_QUALITY").alias("data_quality_score"),
        strongest("BEHAVIOR_EVIDENCE").alias("behavior_evidence_score"),
        strongest("CONTEXT").alias("context_score"),
        F.size(counted).alias("evidence_count"),
    )


# ---------------------------------------------------------------- fusion and verdict

FUSION_SOURCES = (
    ("rule_anomaly", "rule_evidence_score"),
    ("isolation_anomaly", "isolation_score"),
    ("cluster_anomaly", "cluster_score"),
    ("behavior_anomaly", "behavior_evidence_score"),
    ("data_quality_issue", "data_quality_score"),
)


def fuse(df: DataFrame) -> DataFrame:
    """Active sources, the two-source flag and the mean score of the active sources."""
    on = {f: flag(F.col(f)) for f, _ in FUSION_SOURCES}
    active = total(as_int(on[f]) for f, _ in FUSION_SOURCES)
    weight = total(F.when(on[f], F.coalesce(F.col(s), F.lit(0.0))).otherwise(0.0) for f, s in FUSION_SOURCES)
    counted = pin(df, active.alias("active_sources"), weight.alias("_w"))
    mean = F.coalesce(F.try_divide(F.col("_w"), F.col("active_sources")), F.lit(0.0))
    return counted.select(
        *df.columns, "active_sources", (F.col("active_sources") >= 2).alias("multi_source_anomaly"),
        round_decimal(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)), 4).alias("fusion_score"),
    )


def record_verdict(df: DataFrame, cause_count: Column, threshold: float = 0.5) -> DataFrame:
    """Anomaly when any source speaks, several agree or the fused score is high enough."""
    sources = any_of(flag(F.col(c)) for c in ("rule_anomaly", "isolation_anomaly", "cluster_anomaly", "behavior_anomaly"))
    return df.withColumn("anomaly_detected", sources | (cause_count > 0) | flag(F.col("multi_source_anomaly")) | (F.col("fusion_score") >= threshold))


# ---------------------------------------------------------------- root causes

# Cause and description per rule, change rules by severity.
ROOT_CAUSES = {
    "negative_value": ("invalid_negative_value", "A numerical pharmacy value contains an invalid negative value."),
    "fills_without_claims": ("fills_without_claims", "Fill activity exists without corresponding claims."),
    "cost_without_claims": ("cost_without_claims", "Drug cost exists without corresponding claims."),
    "ge65_exceeds_total": ("ge65_total_inconsistency", "GE65 values exceed the corresponding total pharmacy values."),
    "missing_critical_value": ("missing_critical_data", "A critical pharmacy data field is missing."),
    "drug_cost_change_high": ("extreme_drug_cost_change", "Drug cost changed significantly compared with historical behavior."),
    "drug_cost_change_medium": ("unusual_drug_cost_change", "Drug cost changed unusually compared with historical behavior."),
    "claim_volume_change_high": ("extreme_claim_volume_change", "Claim volume changed significantly compared with historical behavior."),
    "claim_volume_change_medium": ("unusual_claim_volume_change", "Claim volume changed unusually compared with historical behavior."),
    "fill_volume_change_high": ("extreme_fill_volume_change", "Fill volume changed significantly compared with historical behavior."),
    "fill_volume_change_medium": ("unusual_fill_volume_change", "Fill volume changed unusually compared with historical behavior."),
    "days_supply_change_high": ("extreme_days_supply_change", "Day supply changed significantly compared with historical behavior."),
    "days_supply_change_medium": ("unusual_days_supply_change", "Day supply changed unusually compared with historical behavior."),
    "beneficiary_change_high": ("extreme_beneficiary_change", "Beneficiary volume changed significantly compared with historical behavior."),
    "beneficiary_change_medium": ("unusual_beneficiary_change", "Beneficiary volume changed unusually compared with historical behavior."),
    "cost_per_claim_change_high": ("extreme_cost_per_claim_change", "Cost per claim changed significantly compared with historical behavior."),
    "cost_per_claim_change_medium": ("unusual_cost_per_claim_change", "Cost per claim changed unusually compared with historical behavior."),
    "cost_per_claim_high": ("unusual_cost_per_claim", "The cost per claim is statistically unusual."),
    "cost_per_claim_medium": ("unusual_cost_per_claim", "The cost per claim is higher than expected."),
    "cost_per_beneficiary_high": ("unusual_cost_per_beneficiary", "The drug cost per beneficiary is statistically unusual."),
    "cost_per_beneficiary_medium": ("unusual_cost_per_beneficiary", "The drug cost per beneficiary is higher than expected."),
    "cost_per_day_supply_high": ("unusual_cost_per_day_supply", "The drug cost per day of supply is statistically unusual."),
    "cost_per_day_supply_medium": ("unusual_cost_per_day_supply", "The drug cost per day of supply is higher than expected."),
    "day_supply_per_claim_high": ("unusual_day_supply_per_claim", "The day supply per claim is statistically unusual."),
    "day_supply_per_claim_medium": ("unusual_day_supply_per_claim", "The day supply per claim is higher than expected."),
    "claims_per_beneficiary_high": ("unusual_claims_per_beneficiary", "The number of claims per beneficiary is statistically unusual."),
    "claims_per_beneficiary_medium": ("unusual_claims_per_beneficiary", "The number of claims per beneficiary is higher than expected."),
    "fills_per_claim_high": ("unusual_fills_per_claim", "The number of fills per claim is unusually high."),
    "fills_per_claim_medium": ("unusual_fills_per_claim", "The number of fills per claim is higher than expected."),
}


def root_causes(df: DataFrame) -> DataFrame:
    """Distinct causes of the evidence (hard first, then behaviour, then quality) and a context text."""
    ordered = F.concat(
        F.filter("evidence", lambda e: e["category"] == "HARD_ANOMALY"),
        F.filter("evidence", lambda e: e["category"] == "BEHAVIOR_EVIDENCE"),
        F.filter("evidence", lambda e: e["category"] == "DATA_QUALITY"),
    )
    causes = {k: v[0] for k, v in ROOT_CAUSES.items()}
    texts = {k: v[1] for k, v in ROOT_CAUSES.items()}

    def cause(e: Column) -> Column:
        key = F.when(e["rule"].isin(*[c for c, _ in CHANGE_RULES]), F.concat(e["rule"], F.lit("_"), F.lower(e["severity"]))).otherwise(e["rule"])
        fallback = F.concat(F.lit("Anomaly rule '"), e["rule"], F.lit("' was triggered."))
        return F.struct(lookup(causes, key, e["rule"]).alias("cause"), lookup(texts, key, fallback).alias("description"))

    listed = df.withColumn("root_causes", F.array_distinct(F.transform(ordered, cause)))
    text = F.concat(F.lit("Rule-based pharmacy anomaly evidence detected: "), F.array_join("root_causes.description", " "))
    return listed.withColumn("context_for_retrieval", F.when(F.size("root_causes") > 0, text).otherwise(""))
