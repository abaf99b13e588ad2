"""Human-readable evidence and explanations per anomalous record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag, with_scalars
from wardenframe.functions.quantiles import quantile_row

SUMMARY_ITEMS = 5
MISSING_RATE_LIMIT = 0.25


def label(feature: str) -> str:
    return feature.replace("_", " ")


def number_text(value: Column) -> Column:
    """Fewer decimals for larger numbers."""
    size = F.abs(value)
    return (
        F.when(size >= 1000, F.format_string("%,.2f", F.round(value, 2)))
        .when(size >= 1, F.format_string("%.3f", F.round(value, 3)))
        .otherwise(F.format_string("%.4f", F.round(value, 4)))
    )


def _item(kind: str, feature: str, message: Column, value: Column, when: Column) -> Column:
    return F.when(
        flag(when), F.struct(F.lit(kind).alias("type"), F.lit(feature).alias("feature"), message.alias("message"), value.cast("double").alias("value"))
    )


def generate_evidence(df: DataFrame, anomalous: Column, quality_flags: Sequence[str], rates: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Evidence list, count, severity, type counts, features and a short summary of each anomalous row.

    The 1st and 99th percentiles come from all rows, also the normal ones.
    """
    bounds = quantile_row(df, rates, {"p01": 0.01, "p99": 0.99})
    wide = with_scalars(df, bounds, "_b").where(flag(anomalous))
    missing, share = F.col("total_important_missing_count"), F.col("important_missing_rate")
    items = [_item("DATA_QUALITY_FLAG", c, F.lit(f"{label(c)} is triggered."), F.lit(1), F.col(c) == 1) for c in quality_flags]
    items.append(_item(
        "MISSINGNESS", "total_important_missing_count",
        F.concat(missing.cast("string"), F.lit(" important data fields are missing or unavailable.")), missing, missing > 0,
    ))
    items.append(_item(
        "MISSINGNESS", "important_missing_rate",
        F.concat(F.lit("Important missingness rate is "), F.format_string("%.1f%%", F.round(share * 100, 1)), F.lit(".")), share, share >= MISSING_RATE_LIMIT,
    ))
    for c in rates:
        value, low, high = F.col(c), F.col(f"_b.{c}__p01"), F.col(f"_b.{c}__p99")

        def text(side: str, limit: Column, value: Column = value, c: str = c) -> Column:
            return F.concat(F.lit(f"{label(c)} = "), number_text(value), F.lit(f", {side} percentile ("), number_text(limit), F.lit(")."))

        items.append(_item("EXTREME_HIGH", c, text("above the dataset 99th", high), value, value > high))
        items.append(_item("EXTREME_LOW", c, text("below the dataset 1st", low), value, flag(value < low) & ~flag(value > high)))
    items += [
        _item("DATA_QUALITY_FLAG", f"{c}_invalid_flag", F.lit(f"{label(c)} contains an invalid raw value."), F.lit(1), F.col(f"{c}_invalid_flag") == 1)
        for c in rates
        if f"{c}_invalid_flag" in df.columns
    ]
    listed = wide.select(*keep, F.array_distinct(F.array_compact(F.array(*items))).alias("evidence"))
    types = F.col("evidence.type")
    names = F.array_distinct(types)
    counts = F.map_from_entries(F.transform(names, lambda t: F.struct(t, F.size(F.filter(F.col("evidence"), lambda e: e["type"] == t)))))
    n = F.size("evidence")
    head = F.array_join(F.slice("evidence.message", 1, SUMMARY_ITEMS), " ")
    more = F.concat(head, F.lit(" "), (n - SUMMARY_ITEMS).cast("string"), F.lit(" additional evidence item(s)."))
    severe = F.array_contains(types, "DATA_QUALITY_FLAG") | F.array_contains(types, "EXTREME_HIGH")
    middling = F.array_contains(types, "EXTREME_LOW") | F.array_contains(types, "MISSINGNESS")
    return listed.select(
        *keep,
        n.alias("evidence_count"),
        F.when(severe, "HIGH").when(middling, "MEDIUM").otherwise("LOW").alias("evidence_severity"),
        F.to_json(counts).alias("evidence_types"),
        F.array_join("evidence.feature", ",").alias("evidence_features"),
        F.when(n > SUMMARY_ITEMS, more).otherwise(head).alias("evidence_summary"),
        "evidence",
    )


# ---------------------------------------------------------------- explanations

# Texts per anomaly type.
NO_FIELD_TEXT = (
    "The record was identified as statistically unusual by the Isolation Forest model, but no individual field exceeded the explanation threshold."
)
PATTERN_TEXT = "The Isolation Forest identified an unusual pattern. The following fields differ significantly from the normal PUF distribution: "
NO_FIELD_CAUSE = "Possible unusual reporting volume, data-entry issue, missing value, aggregation problem, or unexpected operational event."
FIELD_CAUSE = (
    "The anomaly is associated with unusual values in ",
    ". Possible causes include reporting errors, incorrect aggregation, duplicate records, or an unusual operational event.",
)
ML_FIX = (
    "Validate the highlighted fields against the source system. Compare the plan with similar plans and check for duplicate records, "
    "incorrect aggregation, missing values, or unusual reporting patterns."
)
FIXED_TEXTS = {
    "NORMAL": ("No anomaly detected.", "No immediate data-quality issue identified.", "No action required."),
    "RULE": (
        None,
        "The record violates a predefined data-quality or business consistency rule.",
        "Validate the affected fields against the source claims or authorization data and correct the underlying data issue.",
    ),
    "RULE + ML": (
        None,
        "A known rule violation is present and the overall record also shows an unusual statistical pattern.",
        "Prioritize source-data validation. Check the rule-violating fields first, then investigate the additional unusual fields identified by ML.",
    ),
}
OTHER_TEXTS = ("Anomaly detected.", "Requires further investigation.", "Validate the record against the source system.")


def unusual_fields(df: DataFrame, fields: Mapping[str, str], keep: Sequence[str], threshold: float = 2.0, top: int = 5) -> DataFrame:
    """Add ``unusual``: the fields farthest from the mean in deviations, at most ``top`` (a top-k report)."""
    stats = df.agg(*[f(c).alias(f"{c}__{n}") for c in fields for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    wide = with_scalars(df, stats, "_s")
    items = []
    for c, text in fields.items():
        sd = F.col(f"_s.{c}__sd")
        z = F.abs(F.try_divide(F.col(c) - F.col(f"_s.{c}__mean"), F.when(sd > 0, sd)))
        direction = F.when(F.col(c) > F.col(f"_s.{c}__mean"), "high").otherwise("low")
        items.append(F.when(flag(z >= threshold), F.struct(
            (-F.round(z, 6)).alias("order"), F.lit(c).alias("field"), F.lit(text).alias("label"), direction.alias("direction"), F.col(c).alias("value")
        )))
    ranked = F.slice(F.sort_array(F.array_compact(F.array(*items))), 1, top)
    return wide.select(*keep, ranked.alias("unusual"))


def explain(df: DataFrame, anomaly_type: str = "anomaly_type", rule_reason: str = "rule_reason") -> DataFrame:
    """Explanation, likely cause and fix from the anomaly type and the ``unusual`` fields."""
    kind, unusual = F.col(anomaly_type), F.col("unusual")
    phrases = F.transform(unusual, lambda u: F.concat(u["label"], F.lit(" is unusually "), u["direction"]))
    none = F.size(unusual) == 0
    model_text = F.when(none, NO_FIELD_TEXT).otherwise(F.concat(F.lit(PATTERN_TEXT), F.array_join(phrases, "; "), F.lit(".")))
    first = F.array_join(F.slice(F.transform(unusual, lambda u: u["label"]), 1, 3), ", ")
    model_cause = F.when(none, NO_FIELD_CAUSE).otherwise(F.concat(F.lit(FIELD_CAUSE[0]), first, F.lit(FIELD_CAUSE[1])))

    def by_type(position: int, special: Mapping[str, Column]) -> Column:
        out = F.when(kind == "ML", special["ML"])
        for name, texts in FIXED_TEXTS.items():
            out = out.when(kind == name, special.get(name, F.lit(texts[position])))
        return out.otherwise(OTHER_TEXTS[position])

    return df.select(
        "*",
        by_type(0, {"ML": model_text, "RULE": F.col(rule_reason), "RULE + ML": F.concat(F.col(rule_reason), F.lit(". "), model_text)}).alias("explanation"),
        by_type(1, {"ML": model_cause}).alias("likely_cause"),
        by_type(2, {"ML": F.lit(ML_FIX)}).alias("recommended_fix"),
    )
