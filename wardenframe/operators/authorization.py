"""Authorization records: features, rules with trained fences, risk and texts."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import as_int, flag, join_present, strict_date, tiers, to_number, total, with_scalars
from wardenframe.functions.quantiles import quantile_row
from wardenframe.operators.cleaning import category_text, prefix

# Fixed values.
DATE_COLUMNS = ("request_date", "approval_date", "valid_from_date", "valid_to_date")
CRITICAL_COLUMNS = (
    "patient_id", "provider_id", "request_date", "authorization_type", "service_code", "requested_quantity", "charged_amount", "approval_status",
)
CATEGORY_COLUMNS = ("authorization_type", "approval_status", "service_description")
CAUSE_TEXTS = {
    "missing_data": "One or more critical fields are missing",
    "invalid_date": "One or more date values have an invalid format",
    "future_request": "The request date is in the future",
    "approval_before_request": "The approval date occurs before the request date",
    "invalid_validity_range": "The validity end date occurs before the validity start date",
    "negative_quantity": "The requested quantity is negative",
    "negative_amount": "The charged amount is negative",
    "unusual_quantity": "The requested quantity is statistically unusual",
    "unusual_amount": "The charged amount is statistically unusual",
    "duplicate_record": "The record is duplicated",
}
CAUSES = tuple(CAUSE_TEXTS)
SEPARATOR = ";"


def authorization_features(df: DataFrame) -> DataFrame:
    """Gap and date counts, day differences, numbers, gap flags and category texts of each record."""
    have = df.columns
    dates = [c for c in DATE_COLUMNS if c in have]
    parsed = df.select("*", *[strict_date(c).alias(f"_{c}") for c in dates])

    def days(end: str, start: str) -> Column:
        return F.datediff(F.col(f"_{end}"), F.col(f"_{start}")).cast("double")

    return parsed.select(
        *have,
        *[f"_{c}" for c in dates],
        total(F.col(c).isNull().cast("int") for c in CRITICAL_COLUMNS if c in have).alias("missing_critical_count"),
        total((F.col(c).isNotNull() & F.col(f"_{c}").isNull()).cast("int") for c in dates).alias("invalid_date_count"),
        days("approval_date", "request_date").alias("approval_delay_days"),
        days("valid_to_date", "valid_from_date").alias("validity_duration_days"),
        days("valid_from_date", "request_date").alias("request_to_valid_days"),
        to_number("requested_quantity").alias("quantity"),
        to_number("charged_amount").alias("amount"),
        *[F.col(c).isNull().cast("int").alias(f"{c}_missing_flag") for c in have],
        *[(category_text(c) if c in have else F.lit("__MISSING__")).alias(f"{c}_text") for c in CATEGORY_COLUMNS],
        (prefix("service_code") if "service_code" in have else F.lit("OTHER")).alias("service_code_prefix"),
    )


def train_fences(features: DataFrame, factor: float = 1.5) -> DataFrame:
    """One row of lower and upper limits; open-ended where a column has no value."""
    row = quantile_row(features, ["quantity", "amount"], {"q1": 0.25, "q3": 0.75})
    out = []
    for c in ("quantity", "amount"):
        q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
        out.append(F.coalesce(q1 - factor * (q3 - q1), F.lit(float("-inf"))).alias(f"{c}_lower"))
        out.append(F.coalesce(q3 + factor * (q3 - q1), F.lit(float("inf"))).alias(f"{c}_upper"))
    return row.select(*out)


def run_rules(features: DataFrame, fences: DataFrame, as_of: datetime.date, record_columns: Sequence[str]) -> DataFrame:
    """Ten cause flags, their count and the rule flag. ``as_of`` stands for today."""
    marked = mark_row_copies(features, record_columns, "_copy")
    wide = with_scalars(marked, fences, "_f")
    request, approval = F.col("_request_date"), F.col("_approval_date")
    start, end = F.col("_valid_from_date"), F.col("_valid_to_date")

    def outside(c: str) -> Column:
        return (F.col(c) < F.col(f"_f.{c}_lower")) | (F.col(c) > F.col(f"_f.{c}_upper"))

    tests = {
        "missing_data": F.col("missing_critical_count") > 0,
        "invalid_date": F.col("invalid_date_count") > 0,
        "future_request": request > F.lit(as_of),
        "approval_before_request": approval < request,
        "invalid_validity_range": end < start,
        "negative_quantity": F.col("quantity") < 0,
        "negative_amount": F.col("amount") < 0,
        "unusual_quantity": outside("quantity"),
        "unusual_amount": outside("amount"),
        "duplicate_record": F.col("_copy"),
    }
    flagged = wide.select(*features.columns, *[flag(p).alias(c) for c, p in tests.items()])
    count = total(F.col(c).cast("int") for c in CAUSES)
    return flagged.select("*", count.alias("rule_anomaly_count"), (count > 0).cast("int").alias("rule_anomaly_flag"))


def mark_row_copies(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Flag full-row copies over ``columns``; a missing value equals a missing value."""
    repeated = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    keys = repeated.toDF(*[f"_k_{c}" for c in columns], "_copies")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in columns])
    return df.join(keys, same, "left").select(*df.columns, F.col("_copies").isNotNull().alias(name))


def rule_severity(count: Column) -> Column:
    return F.when(count == 0, "NONE").when(count == 1, "LOW").when(count <= 3, "MEDIUM").otherwise("HIGH")


def score_severity(score: Column, medium: Column, high: Column) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def model_name(df: DataFrame) -> Column:
    """Name of the model that scored a row: ``ml_model``, where there is such a column."""
    return F.col("ml_model") if "ml_model" in df.columns else F.lit("Isolation Forest")


def risk(df: DataFrame) -> DataFrame:
    """Rule part (15 each, at most 50), model part (40/30/20), agreement bonus 10; level and reasons."""
    count, severity = F.col("rule_anomaly_count"), F.col("ml_anomaly_severity")
    model, rule = F.col("ml_anomaly_flag") == 1, F.col("rule_anomaly_flag") == 1
    model_part = F.when(model, F.when(severity == "HIGH", 40).when(severity == "MEDIUM", 30).otherwise(20)).otherwise(0)
    both = rule & model
    score = F.least(F.least(count * 15, F.lit(50)) + model_part + F.when(both, 10).otherwise(0), F.lit(100)).cast("int")
    reasons = [
        (count > 0, F.concat(count.cast("string"), F.lit(" rule violation(s)"))),
        (model, F.concat(model_name(df), F.lit(" anomaly ("), severity, F.lit(")"))),
        (both, "Rule engine and ML both detected the anomaly"),
    ]
    text = join_present("; ", reasons)
    scored = df.withColumn("risk_score", score)
    return scored.select(
        "*",
        tiers(F.col("risk_score"), ((70, "HIGH"), (40, "MEDIUM")), "LOW").alias("risk_level"),
        F.when(text == "", "No anomaly signal detected").otherwise(text).alias("risk_explanation"),
    )


def final_flags(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Final flag (rule or model), network flag, signal list and count."""
    rule, model = F.col("rule_anomaly_flag") == 1, F.col("ml_anomaly_flag") == 1
    network = flag(F.col("bayesian_anomaly_probability") >= threshold)
    names = join_present(SEPARATOR, [(rule, "Rule"), (model, "ML"), (network, "Bayesian")])
    return df.select(
        "*",
        as_int(rule | model).alias("final_anomaly_flag"),
        as_int(network).alias("bayesian_anomaly_flag"),
        F.when(names == "", "None").otherwise(names).alias("signals"),
        (as_int(rule) + as_int(model) + as_int(network)).alias("signal_count"),
    )


def rule_texts(df: DataFrame) -> DataFrame:
    """Names and descriptions of the raised causes."""
    names = join_present(SEPARATOR, [(F.col(c), c.upper()) for c in CAUSES])
    texts = join_present(SEPARATOR, [(F.col(c), t) for c, t in CAUSE_TEXTS.items()])
    none = F.col("rule_anomaly_count") == 0
    return df.select(
        "*", F.when(none, "NONE").otherwise(names).alias("rule_name"), F.when(none, "No rule violation detected").otherwise(texts).alias("rule_reason"),
        rule_severity(F.col("rule_anomaly_count")).alias("rule_severity"),
    )


def model_texts(df: DataFrame) -> DataFrame:
    """Evidence texts of the model signal from the record's probable causes."""
    model, causes, severity = F.col("ml_anomaly_flag") == 1, F.col("probable_root_causes"), F.col("ml_anomaly_severity")
    none = F.size(causes) == 0
    details = F.array_join(F.transform(causes, lambda c: F.concat(
        c["cause"], F.lit(": P(cause|anomaly)="), c["probability_given_anomaly"].cast("string"), F.lit(", lift="), c["bayesian_lift"].cast("string")
    )), "; ")

    def when_on(value: Column, off: Column) -> Column:
        return F.when(model, value).otherwise(off)

    blank = F.lit("")
    return df.select(
        "*",
        when_on(F.size(causes), F.lit(0)).alias("ml_evidence_count"),
        when_on(severity, blank).alias("ml_evidence_severity"),
        when_on(F.lit("MULTIVARIATE_ANOMALY"), blank).alias("ml_evidence_types"),
        when_on(F.when(none, "No configured rule cause identified").otherwise(F.array_join(F.transform(causes, lambda c: c["cause"]), ";")), blank).alias("ml_evidence_features"),
        when_on(F.when(none, F.concat(model_name(df), F.lit(" detected an unusual combination of multiple feature values."))).otherwise(details), blank).alias("ml_evidence_details"),
        when_on(F.concat(model_name(df), F.lit(" detected an unusual multivariate pattern with "), severity, F.lit(" severity.")), blank).alias("ml_evidence_summary"),
    )


def provider_baseline(df: DataFrame, provider: str, measures: Sequence[str]) -> DataFrame:
    """Provider means of the measures and each record's distance from them (aggregate, then join back)."""
    means = df.groupBy(provider).agg(*[F.avg(m).alias(f"provider_avg_{m}") for m in measures])
    joined = df.join(means, provider, "left")
    return joined.select("*", *[(F.col(m) - F.col(f"provider_avg_{m}")).alias(f"{m}_provider_deviation") for m in measures])
