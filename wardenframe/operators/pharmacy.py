"""Prescriber x drug x year: ratios, year-over-year behaviour, rules, decision and SLA status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenframe.functions.columns import (
    any_of,
    as_int,
    flag,
    join_present,
    plain_ratio,
    positive_ratio,
    relative_change,
    tiers,
    with_scalars,
)
from wardenframe.functions.quantiles import quantile_row

KEYS = ("npi", "brand")
YEAR = "data_year"
TOTALS = ("tot_clms", "tot_30day_fills", "tot_day_suply", "tot_drug_cst", "tot_benes")

# Name, numerator, denominator of the guarded ratios.
GUARDED_RATIOS = (
    ("fills_per_claim", "tot_30day_fills", "tot_clms"),
    ("days_supply_per_claim", "tot_day_suply", "tot_clms"),
    ("drug_cost_per_claim", "tot_drug_cst", "tot_clms"),
    ("drug_cost_per_beneficiary", "tot_drug_cst", "tot_benes"),
    ("claims_per_beneficiary", "tot_clms", "tot_benes"),
    ("fills_per_beneficiary", "tot_30day_fills", "tot_benes"),
    ("days_supply_per_beneficiary", "tot_day_suply", "tot_benes"),
    ("drug_cost_per_fill", "tot_drug_cst", "tot_30day_fills"),
)
# Second names of ratios above.
RATIO_ALIASES = (
    ("cost_intensity", "drug_cost_per_claim"),
    ("fill_intensity", "fills_per_claim"),
    ("supply_intensity", "days_supply_per_claim"),
)
# Unguarded behaviour ratios of the prescriber rule set.
BEHAVIOUR_RATIOS = (
    ("cost_per_claim", "tot_drug_cst", "tot_clms"),
    ("claims_per_beneficiary", "tot_clms", "tot_benes"),
    ("cost_per_beneficiary", "tot_drug_cst", "tot_benes"),
    ("day_supply_per_claim", "tot_day_suply", "tot_clms"),
    ("fills_per_claim", "tot_30day_fills", "tot_clms"),
    ("cost_per_day_supply", "tot_drug_cst", "tot_day_suply"),
)
# Change name and the column it is taken from.
YEAR_CHANGES = (
    ("claim_volume_change", "tot_clms"),
    ("fill_volume_change", "tot_30day_fills"),
    ("days_supply_change", "tot_day_suply"),
    ("drug_cost_change", "tot_drug_cst"),
    ("beneficiary_change", "tot_benes"),
    ("cost_per_claim_change", "drug_cost_per_claim"),
    ("fills_per_claim_change", "fills_per_claim"),
    ("days_supply_per_claim_change", "days_supply_per_claim"),
)
# Rule column, source column, reason text.
NEGATIVE_RULES = (
    ("rule_negative_claims", "tot_clms", "Negative claim count"),
    ("rule_negative_fills", "tot_30day_fills", "Negative 30-day fill count"),
    ("rule_negative_day_supply", "tot_day_suply", "Negative day supply"),
    ("rule_negative_drug_cost", "tot_drug_cst", "Negative drug cost"),
    ("rule_negative_beneficiaries", "tot_benes", "Negative beneficiary count"),
)
# Fixed values: "invalid value" rules that repeat a negative rule (all but the last also need a claim count).
INVALID_RULES = (
    ("rule_invalid_fill_value", "tot_30day_fills", True),
    ("rule_invalid_supply_value", "tot_day_suply", True),
    ("rule_invalid_cost_value", "tot_drug_cst", True),
    ("rule_invalid_beneficiary_value", "tot_benes", False),
)
# Rule column, change column, reason text.
EXTREME_RULES = (
    ("rule_extreme_claim_volume_change", "claim_volume_change", "Extreme year-over-year claim volume change"),
    ("rule_extreme_drug_cost_change", "drug_cost_change", "Extreme year-over-year drug cost change"),
    ("rule_extreme_beneficiary_change", "beneficiary_change", "Extreme year-over-year beneficiary change"),
    ("rule_extreme_supply_change", "days_supply_change", "Extreme year-over-year day supply change"),
    ("rule_extreme_fill_change", "fill_volume_change", "Extreme year-over-year fill volume change"),
)
EXTREME_LIMIT = 3.0
ML_TEXT = "Isolation Forest identified unusual pharmacy behavior"


def guarded_ratios(df: DataFrame) -> DataFrame:
    ratios = df.select("*", *[positive_ratio(n, d).alias(name) for name, n, d in GUARDED_RATIOS])
    return ratios.select("*", *[F.col(source).alias(name) for name, source in RATIO_ALIASES])


def behaviour_ratios(df: DataFrame) -> DataFrame:
    return df.select("*", *[plain_ratio(n, d).alias(name) for name, n, d in BEHAVIOUR_RATIOS])


def year_over_year(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    year: str = YEAR,
    changes: Sequence[tuple[str, str]] = YEAR_CHANGES,
    keep_baseline: bool = False,
) -> DataFrame:
    """Compare each record with the same key in the previous available dataset year.

    ``(keys, year)`` must be unique. Then the previous year's record, if there is one, is the row
    just before in the key's year order, so one shuffle on the key replaces a self-join. The first
    year of the data set has nothing to compare with and is left out unless ``keep_baseline``.
    """
    years = df.agg(F.sort_array(F.collect_set(year)).alias("years"))  # as many values as there are years
    dated = with_scalars(df, years, "_set")
    at = F.array_position("_set.years", F.col(year))
    dated = dated.withColumn("_prior_year", F.when(at > 1, F.element_at("_set.years", (at - 1).cast("int")))).drop("_set")
    by_key = Window.partitionBy(*keys).orderBy(year)
    sources = list(dict.fromkeys(source for _, source in changes))
    known = F.lag(year).over(by_key) == F.col("_prior_year")
    looked_up = dated.select(
        "*",
        flag(known).alias("previous_year_record_exists"),
        *[F.when(known, F.lag(s).over(by_key)).alias(f"previous_{s}") for s in sources],
    )
    if not keep_baseline:
        looked_up = looked_up.where(F.col("_prior_year").isNotNull())
    return looked_up.select(
        *df.columns,
        *[f"previous_{s}" for s in sources],
        *[relative_change(s, f"previous_{s}").alias(name) for name, s in changes],
        (~F.col("previous_year_record_exists")).alias("new_pharmacy_record"),
        "previous_year_record_exists",
    )


def extreme(change: str, limit: float = EXTREME_LIMIT) -> Column:
    return flag(F.abs(F.col(change)) > limit)


def pharmacy_rules(df: DataFrame, limit: float = EXTREME_LIMIT) -> DataFrame:
    """Fourteen rule flags, verdict, severity and the joined reasons."""
    negative = [(name, flag(F.col(c) < 0), text) for name, c, text in NEGATIVE_RULES]
    by_column = {c: flag(F.col(c) < 0) for _, c, _ in NEGATIVE_RULES}
    invalid = [
        (name, by_column[c] & F.col("tot_clms").isNotNull() if needs_claims else by_column[c])
        for name, c, needs_claims in INVALID_RULES
    ]
    extremes = [(name, extreme(c, limit), text) for name, c, text in EXTREME_RULES]
    any_negative = any_of(p for _, p, _ in negative)
    any_extreme = any_of(p for _, p, _ in extremes)
    return df.select(
        "*",
        *[p.alias(name) for name, p, _ in negative],
        *[p.alias(name) for name, p in invalid],
        *[p.alias(name) for name, p, _ in extremes],
        (any_negative | any_extreme).alias("rule_anomaly"),
        F.when(any_negative, "HIGH").when(any_extreme, "MEDIUM").otherwise("NORMAL").alias("rule_severity"),
        join_present("; ", [(p, text) for _, p, text in [*negative, *extremes]]).alias("rule_reason"),
    )


def fence_flag(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Add ``ml_anomaly`` / ``ml_anomaly_score`` from a quartile fence on one column."""
    bounds = quantile_row(df, [column], {"q1": 0.25, "q3": 0.75})
    spread = with_scalars(df, bounds, "_b")
    q1, q3 = F.col(f"_b.{column}__q1"), F.col(f"_b.{column}__q3")
    outside = flag((F.col(column) < q1 - factor * (q3 - q1)) | (F.col(column) > q3 + factor * (q3 - q1)))
    return spread.select(*df.columns, outside.alias("ml_anomaly"), F.col(column).alias("ml_anomaly_score"))


def decide(df: DataFrame, limit: float = EXTREME_LIMIT) -> DataFrame:
    """Fuse rule, model and behaviour signals of a row into flag, risk, severity, source and text.

    The text names the model of the column ``ml_model``, where there is one.
    """
    rule, model = flag(F.col("rule_anomaly")), flag(F.col("ml_anomaly"))
    behaviour = any_of(extreme(c, limit) for _, c, _ in EXTREME_RULES)
    marked = df.select("*", rule.alias("_rule"), model.alias("_ml"), behaviour.alias("behavior_anomaly"))
    rule, model, behaviour = F.col("_rule"), F.col("_ml"), F.col("behavior_anomaly")
    risk = as_int(rule) * 0.4 + as_int(model) * 0.4 + as_int(behaviour) * 0.2
    text = F.concat("ml_model", F.lit(ML_TEXT.removeprefix("Isolation Forest"))) if "ml_model" in df.columns else ML_TEXT
    texts = [(rule, F.col("rule_reason")), (model, text)] + [(extreme(c, limit), t) for _, c, t in EXTREME_RULES[:3]]
    return marked.select(
        *df.columns,
        "behavior_anomaly",
        (rule | model | behaviour).alias("final_anomaly"),
        F.round(risk, 2).alias("final_risk_score"),
        F.when(rule & model, "CRITICAL").when(rule | model, "HIGH").when(behaviour, "MEDIUM").otherwise("NORMAL").alias("final_severity"),
        F.when(rule & model, "RULE + ML").when(rule, "RULE").when(model, "ML").when(behaviour, "BEHAVIOR").otherwise("NORMAL").alias("detection_source"),
        join_present("; ", texts).alias("explanation"),
    )


# Fixed values: (lower limit, risk) from high to low.
WORKLOAD_TIERS = ((100_000, 0.30), (50_000, 0.20), (10_000, 0.10))
VOLUME_TIERS = ((3, 0.30), (2, 0.20), (1, 0.10))


def sla_status(df: DataFrame, workload_tiers: Sequence[tuple[float, float]] = WORKLOAD_TIERS) -> DataFrame:
    """Workload, volume, model and quality risk, their capped sum and YES / MAYBE / NO."""
    parts = df.select(
        "*",
        tiers(F.col("tot_clms"), workload_tiers, 0.0).alias("workload_risk"),
        tiers(F.abs(F.coalesce("claim_volume_change", F.lit(0.0))), VOLUME_TIERS, 0.0).alias("volume_risk"),
        (as_int(F.col("ml_anomaly")) * 0.25).alias("ml_risk"),
        (as_int(F.col("rule_anomaly")) * 0.15).alias("quality_risk"),
    )
    # Rounding first keeps 0.30 + 0.25 + 0.15 at the 0.70 limit.
    combined = F.round(F.col("workload_risk") + F.col("volume_risk") + F.col("ml_risk") + F.col("quality_risk"), 4)
    scored = parts.withColumn("sla_breach_probability", F.least(F.lit(1.0), combined))
    return scored.withColumn("sla_status", tiers(F.col("sla_breach_probability"), ((0.70, "NO"), (0.40, "MAYBE")), "YES"))
