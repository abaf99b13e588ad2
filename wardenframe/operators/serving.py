"""Anomaly lists, counts and trends as a dashboard asks for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import lookup, round_decimal, severity_rank, tiers, with_scalars

# Severities from weak to strong.
SEVERITY_ORDER = ("NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SCORE_BANDS = ((80, "Critical"), (50, "High"), (20, "Medium"))


def severity_priority(severity: str | Column) -> Column:
    """Rank by meaning, not by alphabet."""
    return severity_rank(severity, SEVERITY_ORDER)


def top_by_score(df: DataFrame, score: str, tie_breaks: Sequence[str], top: int = 20) -> DataFrame:
    return df.orderBy(F.desc(score), *tie_breaks).limit(top)


def filter_anomalies(
    df: DataFrame, source: str | None = None, severity: str | None = None, status: str | None = None, search: str | None = None
) -> DataFrame:
    """Filters of the anomaly list; ``search`` looks into record id, type and source."""
    out = df
    for column, wanted in (("source_dataset", source), ("severity", severity), ("status", status)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    if search:
        pattern = f"%{search}%"
        out = out.where(F.ilike("record_id", F.lit(pattern)) | F.ilike("anomaly_type", F.lit(pattern)) | F.ilike("source_dataset", F.lit(pattern)))
    return out


def page(df: DataFrame, number: int, size: int, newest: str = "detected_at", key: str = "id") -> DataFrame:
    """One page, newest first, with the key to break ties."""
    return df.orderBy(F.desc(newest), F.desc(key)).offset((number - 1) * size).limit(size)


def score_band(score: str | Column) -> Column:
    return tiers(F.col(score) if isinstance(score, str) else score, SCORE_BANDS, "Low")


def keyword_search(df: DataFrame, title: str, tags: str, term: str) -> DataFrame:
    """Case-insensitive: in the title or in any tag."""
    wanted = term.lower()
    return df.where(F.contains(F.lower(title), F.lit(wanted)) | F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(wanted))))


def latest_state(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Newest entry per key of an append-only change log, by aggregation (no window, no per-key sort)."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("s"))
    return newest.select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def new_records(incoming: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(known.select(*keys), list(keys), "left_anti")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return first.select(*key, *[F.col(f"s.{c}").alias(c) for c in rest])


# ---------------------------------------------------------------- counts and trends

# Labels of the store.
STORE_SEVERITIES = {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW", "CRITICAL": "CRITICAL", "NORMAL": "LOW"}


def store_severity(raw: Column) -> Column:
    """Severity text to the store's enumeration; unknown text is MEDIUM."""
    return lookup(STORE_SEVERITIES, F.upper(raw), F.lit("MEDIUM"))


def store_type(raw: Column) -> Column:
    """Detection label to the store's anomaly type."""
    text = F.upper(raw)
    rule, model = F.contains(text, F.lit("RULE")), F.contains(text, F.lit("ML"))
    return F.when(rule & model, "INVALID_DOMAIN").when(rule, "NEGATIVE_VALUE").when(model, "SLA_PROCESSING_SPIKE").otherwise("MISSING_FIELD")


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("records"))


def trend(df: DataFrame, at: str, unit: str = "day", category: str | None = None) -> DataFrame:
    """Anomalies per period, optionally per category."""
    period = F.date_format(F.date_trunc(unit, F.col(at)), "yyyy-MM-dd").alias("period")
    return df.groupBy(period, *([category] if category else [])).agg(F.count(F.lit(1)).alias("anomalies"))


def percent(part: Column, whole: Column) -> Column:
    return round_decimal(F.try_divide(part * 100.0, whole), 4)


def check_pass_rates(checks: DataFrame, kind: str, checked: str, failed: str) -> DataFrame:
    """Pass rate of the checks of each type."""
    return checks.groupBy(kind).agg(
        F.count(F.lit(1)).alias("checks"), F.sum(checked).alias("records_checked"), F.sum(failed).alias("records_failed"),
        percent(F.sum(checked) - F.sum(failed), F.sum(checked)).alias("pass_rate"),
    )


def dashboard_summary(store: DataFrame, open_states: Sequence[str] = ("OPEN", "IN_PROGRESS")) -> DataFrame:
    """Records, pass rate, open anomalies, SLA breaches and mean resolution time in one aggregate."""
    n = F.count(F.lit(1))
    return store.agg(
        n.alias("total_records"),
        percent(F.count_if(F.col("severity") == "LOW"), n).alias("pass_rate"),
        F.count_if(F.col("status").isin(*open_states)).alias("open_anomalies"),
        F.count_if(F.col("sla_state") == "breached").alias("sla_breaches"),
        round_decimal(F.avg(F.when(F.col("status") == "RESOLVED", F.col("resolution_hours"))), 4).alias("avg_resolution_hours"),
    )


def source_totals(sources: DataFrame, kind: str) -> DataFrame:
    return sources.groupBy(kind).agg(
        F.count(F.lit(1)).alias("sources"), F.sum("records").alias("records"), F.sum("errors").alias("errors"), F.count_if(F.col("status") == "healthy").alias("healthy")
    )


def helpful_rate(feedback: DataFrame, helpful: Column) -> DataFrame:
    n = F.count(F.lit(1))
    return feedback.agg(n.alias("feedback"), F.count_if(helpful).alias("helpful"), F.count_if(~helpful).alias("not_helpful"), percent(F.count_if(helpful), n).alias("helpful_rate"))


def confidence_summary(recommendations: DataFrame, confidence: str, sure: float = 90) -> DataFrame:
    return recommendations.agg(
        F.count(F.lit(1)).alias("recommendations"),
        round_decimal(F.avg(F.col(confidence).cast("decimal(20,4)")), 4).alias("mean_confidence"),
        F.count_if(F.col(confidence) >= sure).alias("sure"),
    )


def sla_compliance(items: DataFrame, state: str) -> DataFrame:
    """Share of items that are not breached; 100 when there is none."""
    n = F.count(F.lit(1))
    return items.agg(n.alias("items"), F.coalesce(percent(F.count_if(F.col(state) != "breached"), F.nullif(n, F.lit(0))), F.lit(100.0)).alias("compliance"))


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale to 0..1 over the table; all 0 when every value is equal."""
    wide = with_scalars(df, df.agg(F.min(column).alias("low"), F.max(column).alias("high")), "_mm")
    spread = F.col("_mm.high") - F.col("_mm.low")
    scaled = F.when(spread > 0, (F.col(column) - F.col("_mm.low")) / spread).otherwise(0.0)
    return wide.select(*df.columns, scaled.alias(name))
