"""Univariate outlier detection over many features, in long form: statistics by feature, flags by cell, counts by row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag, unpivot_numeric
from wardenframe.functions.quantiles import quantile_row

# Words that mark rate and count features.
RATE_WORDS = ("rate", "percent", "percentage")
COUNT_WORDS = ("claims", "appeals", "enrollment", "disenrollment", "denied", "resubmitted")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the detector (fixed values as defaults; the upper bound of a rate is a parameter)."""

    z: float = 3.0
    fence: float = 1.5
    low: float = 0.01
    high: float = 0.99
    minimum_values: int = 20
    minimum_spread: float = 1e-12
    rate_upper: float = 100.0
    high_count: int = 5
    medium_count: int = 2
    high_ratio: float = 0.10
    medium_ratio: float = 0.03
    missing_high: float = 0.75


def feature_statistics(df: DataFrame, features: Sequence[str], limits: Limits = Limits()) -> dict[str, dict[str, float | None]]:
    """Count, mean, deviation and the four quantiles of every feature: one group each, fetched."""
    value = F.col("value")
    moments = unpivot_numeric(df, features).groupBy("feature").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    found = {r["feature"]: {n: r[n] for n in ("n", "mean", "sd")} for r in moments.collect()}
    probs = {"low": limits.low, "q1": 0.25, "q3": 0.75, "high": limits.high}
    quantiles = quantile_row(df, features, probs).first()
    return {c: found.get(c, {"n": 0, "mean": None, "sd": None}) | {p: quantiles[f"{c}__{p}"] for p in probs} for c in features}


_BOUNDS = "feature string, place int, mean double, sd double, fence_low double, fence_high double, low double, high double, rate boolean, counted boolean"


def feature_bounds(features: Sequence[str], stats: Mapping[str, Mapping[str, float | None]], limits: Limits) -> list[tuple]:
    """One row of bounds per feature; a missing bound is never passed, as where a feature has too few values to judge."""
    rows = []
    for place, c in enumerate(features):
        s = stats[c]
        judged, spread = s["n"] >= limits.minimum_values, (s["q3"] - s["q1"]) if s["q1"] is not None else 0.0
        moved = judged and s["sd"] is not None and s["sd"] > 0
        fenced = judged and spread > limits.minimum_spread
        rows.append((
            c, place, s["mean"] if moved else None, s["sd"] if moved else None, s["q1"] - limits.fence * spread if fenced else None, s["q3"] + limits.fence * spread if fenced else None,
            s["low"] if judged else None, s["high"] if judged else None, is_rate(c), is_count(c),
        ))
    return rows


def is_rate(name: str) -> bool:
    return any(w in name.lower() for w in RATE_WORDS)


def is_count(name: str) -> bool:
    return any(w in name.lower() for w in COUNT_WORDS)


def detect(df: DataFrame, features: Sequence[str], keep: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """Per row: outlier, percentile, missing and invalid counts, ratios, severity and a feature list.

    ``keep`` names a row; a repeated name is an error. Cells are judged in long form against a table of one row per feature, and gathered by row again;
    a row's cells come one after the other, so they combine before the shuffle. The plan does not grow with the features.
    """
    bounds = df.sparkSession.createDataFrame(feature_bounds(features, feature_statistics(df, features, limits), limits), _BOUNDS)
    cells = unpivot_numeric(df, features, keep).join(F.broadcast(bounds), "feature")
    v = F.col("value")
    score = (v - F.col("mean")) / F.col("sd")
    judged = cells.select(
        *keep, "feature", "place", "value", score.alias("score"), flag(F.abs(score) >= limits.z).alias("z"),
        flag((v < F.col("fence_low")) | (v > F.col("fence_high"))).alias("iqr"), flag(v < F.col("low")).alias("below"), flag(v > F.col("high")).alias("above"),
        (F.col("rate") & flag((v < 0) | (v > limits.rate_upper))).alias("bad_rate"), (F.col("counted") & flag(v < 0)).alias("bad_count"),
    )
    shown = F.concat(F.col("feature"), F.lit("="), F.format_string("%.4f", F.round(v, 4)))

    def listed(group: int, when: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(group).alias("group"), "place", text.alias("text")))

    marks = F.array_compact(F.array(
        listed(0, F.col("z") | F.col("iqr"), F.when(F.col("z"), F.concat(shown, F.lit(" [Z="), F.format_string("%.2f", F.round("score", 2)), F.lit("]"))).otherwise(F.concat(shown, F.lit(" [IQR]")))),
        listed(1, F.col("bad_rate"), F.concat(shown, F.lit(" [INVALID_RATE]"))),
        listed(2, F.col("bad_count"), F.concat(shown, F.lit(" [INVALID_NEGATIVE]"))),
    ))

    def count(*flags: Column) -> Column:
        return sum((F.sum(f.cast("int")) for f in flags[1:]), F.sum(flags[0].cast("int"))).cast("int")

    # The list of a row is no longer than its features.
    gathered = judged.withColumn("marks", marks).groupBy(*keep).agg(
        count(F.col("z")).alias("z_outlier_count"), count(F.col("iqr")).alias("iqr_outlier_count"), count(F.col("below")).alias("below_low_percentile"), count(F.col("above")).alias("above_high_percentile"),
        count(F.col("value").isNull()).alias("missing_count"), count(F.col("bad_rate"), F.col("bad_count")).alias("invalid_count"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.size("marks") > 0, F.col("marks"))))).alias("_marks"), F.count(F.lit(1)).alias("_cells"),
    )
    one_row = F.when(F.col("_cells") == len(features), F.concat_ws(" | ", F.transform("_marks", lambda m: m["text"])))
    counted = gathered.withColumn("outlier_features", one_row.otherwise(F.raise_error(F.lit(f"repeated key in {', '.join(keep)}")).cast("string"))).drop("_marks", "_cells")
    return summarise(counted, len(features), limits)


def summarise(counted: DataFrame, n_features: int, limits: Limits = Limits()) -> DataFrame:
    """Severity from counts and shares; missing values alone never make a record severe."""
    outliers = F.col("z_outlier_count") + F.col("iqr_outlier_count")
    rated = counted.select("*", outliers.alias("outlier_count"), (outliers / n_features).alias("outlier_ratio"), (F.col("missing_count") / n_features).alias("missing_ratio"))
    severity = (
        F.when((F.col("invalid_count") > 0) | (F.col("outlier_count") >= limits.high_count) | (F.col("outlier_ratio") >= limits.high_ratio), "HIGH")
        .when((F.col("outlier_count") >= limits.medium_count) | (F.col("outlier_ratio") >= limits.medium_ratio), "MEDIUM")
        .when((F.col("missing_ratio") >= limits.missing_high) | (F.col("outlier_count") == 1), "LOW")
        .otherwise("NORMAL")
    )
    return rated.select("*", (F.col("outlier_count") + F.col("invalid_count")).alias("total_quality_issues"), severity.alias("statistical_severity")).withColumn(
        "statistical_anomaly", F.col("statistical_severity") != "NORMAL"
    )
