"""SLA exposure of records and data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag, is_blank, numeric_lookup, round_decimal, with_scalars

# Severity weights, risk levels and what to do at each level.
SEVERITY_WEIGHTS = {"NONE": 0.0, "LOW": 1.0, "MEDIUM": 2.0, "HIGH": 3.0, "CRITICAL": 4.0}
LEVELS = ((30, "LOW"), (60, "MEDIUM"), (80, "HIGH"))
ACTIONS = {
    "LOW": (
        "Continue Normal Monitoring",
        "Continue standard processing and routine monitoring. No immediate SLA intervention is currently required.",
    ),
    "MEDIUM": (
        "Prioritized Review",
        "Review the affected workload within the defined processing window and prioritize unresolved anomalies before they accumulate into a processing backlog.",
    ),
    "HIGH": (
        "Immediate Prioritization",
        "Prioritize the affected records for resolution and assign them to the appropriate operations queue to reduce the risk of processing delays and potential SLA breach.",
    ),
    "CRITICAL": (
        "Escalation Required",
        "Immediately escalate the affected workload, prioritize critical anomalies, and allocate additional operational resources to prevent an SLA breach.",
    ),
}
ID_KEYS = ("authorization_id", "claim_id", "pharmacy_id", "plan_id", "member_id", "id")


def prescriber_breach(df: DataFrame, workload_seconds: float, batch_size: int = 100_000, threshold: float = 0.5) -> DataFrame:
    """Workload, volume, model, quality and evidence risk with their weighted sum.

    The processing time is a parameter; the data set size is counted from the table.
    """
    size = with_scalars(df, df.agg(F.count(F.lit(1)).alias("n")), "_size")

    def clamp(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    batches = F.floor((F.col("_size.n") + batch_size - 1) / batch_size)
    volume = F.when(batches > 1, F.least(F.lit(1.0), (batches - 1) * 0.1)).otherwise(0.0)
    workload = F.lit(min(workload_seconds / 3600.0, 1.0) if workload_seconds > 0 else 0.0)
    model = clamp(F.greatest(F.coalesce("isolation_score", F.lit(0.0)), F.coalesce("cluster_score", F.lit(0.0))))
    quality = clamp(F.coalesce("data_quality_score", F.lit(0.0)))
    evidence = clamp(F.greatest(F.coalesce("rule_evidence_score", F.lit(0.0)), F.coalesce("behavior_evidence_score", F.lit(0.0))))
    breach = clamp(workload * 0.25 + volume * 0.20 + model * 0.20 + quality * 0.20 + evidence * 0.15)
    parts = {"workload_risk": workload, "volume_risk": volume, "ml_risk": model, "quality_risk": quality, "evidence_risk": evidence}
    return size.select(
        *df.columns, *[round_decimal(v, 4).alias(n) for n, v in parts.items()], round_decimal(breach, 4).alias("breach_probability"), (breach >= threshold).alias("sla_risk")
    )


def risk_level(score: Column) -> Column:
    out = None
    for limit, name in LEVELS:
        out = F.when(score <= limit, name) if out is None else out.when(score <= limit, name)
    return out.otherwise("CRITICAL")


def clean_severity(severity: Column) -> Column:
    text = F.upper(F.trim(severity))
    return F.when(flag(text.isin(*SEVERITY_WEIGHTS)), text).otherwise("NONE")


def weight(severity: Column) -> Column:
    return numeric_lookup(SEVERITY_WEIGHTS, severity, 0.0)


def clamp_percent(score: Column) -> Column:
    return round_decimal(F.greatest(F.lit(0.0), F.least(score, F.lit(100.0))), 2)


def action(level: Column, position: int = 0) -> Column:
    out = None
    for name, texts in ACTIONS.items():
        out = F.when(level == name, texts[position]) if out is None else out.when(level == name, texts[position])
    return out


def record_risk(df: DataFrame, anomaly: str, severity: str, signals: str) -> DataFrame:
    """Half for being an anomaly, three tenths for severity, two tenths for up to three signals."""
    on = flag(F.col(anomaly))
    score = 50.0 + weight(clean_severity(F.col(severity))) / 4 * 30 + F.least(F.greatest(F.coalesce(signals, F.lit(0)), F.lit(0)), F.lit(3)) / 3 * 20
    scored = df.withColumn("risk_score", F.when(on, clamp_percent(score)).otherwise(0.0))
    leveled = scored.withColumn("risk_level", risk_level(F.col("risk_score")))
    return leveled.withColumns({"action": action(F.col("risk_level")), "recommendation": action(F.col("risk_level"), 1)})


def dataset_risk(df: DataFrame, dataset: str, anomaly: str, severity: str, signals: str) -> DataFrame:
    """Per data set: share of anomalies, severity burden, signal burden and their weighted risk."""
    n = F.count(F.lit(1))
    capped = F.least(F.greatest(F.coalesce(signals, F.lit(0)), F.lit(0)), F.lit(3))
    grouped = df.groupBy(dataset).agg(
        n.alias("record_count"),
        F.count_if(flag(F.col(anomaly))).alias("anomalous_records"),
        round_decimal(F.count_if(flag(F.col(anomaly))) * 100.0 / n, 2).alias("anomaly_workload"),
        round_decimal(F.sum(weight(clean_severity(F.col(severity)))) * 100.0 / (n * 4), 2).alias("severity_burden"),
        round_decimal(F.sum(capped) * 100.0 / (n * 3), 2).alias("signal_burden"),
    )
    score = clamp_percent(F.col("anomaly_workload") * 0.5 + F.col("severity_burden") * 0.3 + F.col("signal_burden") * 0.2)
    scored = grouped.withColumn("risk_score", score)
    leveled = scored.withColumn("risk_level", risk_level(F.col("risk_score")))
    return leveled.withColumn("action", action(F.col("risk_level")))


def overall_risk(datasets: DataFrame) -> DataFrame:
    """Record-weighted mean over data sets."""
    row = datasets.agg(
        F.count(F.lit(1)).alias("datasets_processed"),
        F.sum("record_count").alias("total_records"),
        F.sum("anomalous_records").alias("total_anomalous_records"),
        clamp_percent(F.sum(F.col("risk_score") * F.col("record_count")) / F.sum("record_count")).alias("risk_score"),
    )
    leveled = row.withColumn("risk_level", risk_level(F.col("risk_score")))
    rate = round_decimal(F.col("total_anomalous_records") * 100.0 / F.col("total_records"), 2)
    return leveled.withColumns({"overall_anomaly_rate": rate, "action": action(F.col("risk_level")), "recommendation": action(F.col("risk_level"), 1)})


def record_identity(df: DataFrame, keys: Sequence[str] = ID_KEYS) -> Column:
    """First usable identifier, in order of preference, then any other column, else UNKNOWN."""
    known = [c for c in keys if c in df.columns]
    others = [c for c in df.columns if c not in known]
    return F.coalesce(*[F.when(~is_blank(F.col(c).cast("string")), F.col(c).cast("string")) for c in (*known, *others)], F.lit("UNKNOWN"))


def signal_names(signals: Column) -> Column:
    """Signal text to a list; separators of every producer are accepted, 'None' is no signal."""
    parts = F.transform(F.split(F.coalesce(signals, F.lit("")), "[,;|]"), lambda s: F.trim(s))
    return F.when(F.lower(F.trim(signals)) == "none", F.array().cast("array<string>")).otherwise(F.filter(parts, lambda s: s != ""))


def sla_state(detected_at: Column, sla_hours: Column, as_of: Column, at_risk_share: float = 0.8) -> Column:
    """breached after the SLA hours, at_risk in their last part, else on_track."""
    elapsed = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(detected_at.cast("timestamp"))) / 3_600_000_000.0
    return F.when(elapsed > sla_hours, "breached").when(elapsed > sla_hours * at_risk_share, "at_risk").otherwise("on_track")
