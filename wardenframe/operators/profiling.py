"""Column profiles. Every profile is one pass over the table, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag, strict_date, wide_to_rows, with_scalars
from wardenframe.functions.quantiles import quantile_row

SPECIAL_CHARACTER = r"[^a-zA-Z0-9\s\-_./]"
NULL_BUCKET = "<NULL>"
STAT_DIGITS = 6


def dataset_info(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__missing_count") for c in columns],
        *[F.round(F.count_if(F.col(c).isNull()) * 100.0 / F.count(F.lit(1)), 4).alias(f"{c}__missing_percentage") for c in columns],
    )
    return wide_to_rows(row, columns, ("missing_count", "missing_percentage"), {"missing_count": "long", "missing_percentage": "double"})


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, distinct, moments, extremes, exact quartiles, skewness, zero and negative counts."""
    stats = {
        "count": F.count, "mean": lambda c: F.round(F.avg(c), STAT_DIGITS), "std": lambda c: F.round(F.stddev_samp(c), STAT_DIGITS),
        "min": F.min, "max": F.max, "missing": lambda c: F.count_if(F.col(c).isNull()),
        "zero_count": lambda c: F.count_if(F.col(c) == 0), "negative_count": lambda c: F.count_if(F.col(c) < 0),
    }
    types = {n: "long" if n in ("count", "missing", "zero_count", "negative_count", "distinct_values") else "double" for n in stats}
    row = df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in stats.items()])
    basic = wide_to_rows(row, columns, tuple(stats), types)
    # Distinct counts shuffle values, so they go through one long aggregate instead of one expansion per column.
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    distinct = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.lit(1).alias("_one")).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_values")
    )
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = wide_to_rows(quantile_row(df, columns, probs), columns, tuple(probs), {p: "double" for p in probs})
    joined = basic.join(F.broadcast(distinct), "column_name", "left").join(F.broadcast(quartiles), "column_name", "left")
    return joined.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))


def skewness_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample-adjusted skewness per column."""

    def adjusted(c: str):
        n = F.count(c).cast("double")
        return F.round(F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(c)), STAT_DIGITS)

    row = df.agg(*[adjusted(c).alias(f"{c}__skewness") for c in columns])
    return wide_to_rows(row, columns, ("skewness",), {"skewness": "double"})


def _long_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counted = _long_text(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("value", F.coalesce("value", F.lit(NULL_BUCKET)))


def category_profile(df: DataFrame, columns: Sequence[str], top_n: int = 10) -> DataFrame:
    """Most frequent values per column; the rank limit is applied before the shuffle, so a wide column is no hot task."""
    order = Window.partitionBy("column_name").orderBy(F.desc("rows"), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def category_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values (without and with the missing one) and missing rows per column."""
    counted = _long_text(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    return counted.groupBy("column_name").agg(
        F.count("value").alias("unique_count"),
        F.count(F.lit(1)).alias("unique_with_missing"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias("missing_count"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Correlation of every two columns over the rows that hold both; NaN where that is undefined.

    Two passes, means and then products of centred batches, summed by line of the matrix. Only columns x
    columns sums reach the driver.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    first = numbers.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
    mean, size = np.array([first[c] if first[c] is not None else 0.0 for c in columns]), len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, size, size))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - mean
            held = np.isfinite(x)
            x = np.where(held, x, 0.0)
            sums += np.stack([held.T.astype(float) @ held, x.T @ held, (x * x).T @ held, x.T @ x])
        yield pd.DataFrame({"line": np.arange(size), "sums": list(sums.transpose(1, 0, 2).reshape(size, -1))})

    parts = numbers.mapInPandas(run, "line int, sums array<double>").select("line", F.posexplode("sums").alias("at", "v"))
    totals = np.zeros((size, 4 * size))
    for r in parts.groupBy("line", "at").agg(F.sum("v").alias("v")).collect():
        totals[r["line"], r["at"]] = r["v"]
    n, sx, sxx, sxy = totals.reshape(size, 4, size).transpose(1, 0, 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = sxx - sx * sx / n
        return (sxy - sx * sx.T / n) / np.sqrt(np.where(spread > 0, spread, np.nan) * np.where(spread.T > 0, spread.T, np.nan))


def correlation_profile(df: DataFrame, columns: Sequence[str], threshold: float = 0.70) -> DataFrame:
    """Strongly correlated pairs."""
    matrix = correlation_matrix(df, columns)
    pairs = [(a, b, float(matrix[columns.index(a), columns.index(b)])) for a, b in combinations(columns, 2)]
    listed = df.sparkSession.createDataFrame(pairs, "feature_1 string, feature_2 string, correlation double")
    found = listed.withColumn("correlation", F.round("correlation", STAT_DIGITS))
    return found.where(~F.isnan("correlation") & (F.abs("correlation") >= threshold)).orderBy(F.desc(F.abs("correlation")), "feature_1", "feature_2")


def extreme_profile(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Quartile fences per column and the rows outside them."""
    bounds = quantile_row(df, columns, {"q1": 0.25, "q3": 0.75})

    def lower(c: str, base: str = ""):
        return F.col(f"{base}{c}__q1") - factor * (F.col(f"{base}{c}__q3") - F.col(f"{base}{c}__q1"))

    def upper(c: str, base: str = ""):
        return F.col(f"{base}{c}__q3") + factor * (F.col(f"{base}{c}__q3") - F.col(f"{base}{c}__q1"))

    marked = with_scalars(df.select(*columns), bounds, "_b")
    counts = marked.agg(*[
        F.count_if(flag((F.col(c) < lower(c, "_b.")) | (F.col(c) > upper(c, "_b.")))).alias(f"{c}__outliers") for c in columns
    ])
    edges = bounds.select(*[e(c).alias(f"{c}__{n}") for c in columns for n, e in (("lower_bound", lower), ("upper_bound", upper))])
    rows = wide_to_rows(counts, columns, ("outliers",), {"outliers": "long"})
    limits = wide_to_rows(edges, columns, ("lower_bound", "upper_bound"), {"lower_bound": "double", "upper_bound": "double"})
    return rows.join(F.broadcast(limits), "column_name")


def zero_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c) == 0).alias(f"{c}__zero_count") for c in columns])
    return wide_to_rows(row, columns, ("zero_count",), {"zero_count": "long"})


def metric_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum, mean, least and greatest value; sums run in decimals so that order does not matter."""
    row = df.agg(
        *[F.sum(F.col(c).cast("decimal(28,4)")).cast("double").alias(f"{c}__total") for c in columns],
        *[F.round(F.avg(c), STAT_DIGITS).alias(f"{c}__average") for c in columns],
        *[F.min(c).alias(f"{c}__minimum") for c in columns],
        *[F.max(c).alias(f"{c}__maximum") for c in columns],
    )
    names = ("total", "average", "minimum", "maximum")
    return wide_to_rows(row, columns, names, {n: "double" for n in names})


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Special characters, empty text and white-space-only text per column."""
    tests = {
        "special_character_count": lambda c: F.col(c).rlike(SPECIAL_CHARACTER),
        "empty_count": lambda c: F.trim(c) == "",
        "whitespace_only_count": lambda c: F.col(c).rlike(r"^\s+$"),
    }
    row = df.agg(*[F.count_if(flag(t(c))).alias(f"{c}__{n}") for c in columns for n, t in tests.items()])
    return wide_to_rows(row, columns, tuple(tests), {n: "long" for n in tests})


def date_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing dates and values that are no date."""
    row = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__missing_dates") for c in columns],
        *[F.count_if(F.col(c).isNotNull() & strict_date(c).isNull()).alias(f"{c}__invalid_dates") for c in columns],
    )
    return wide_to_rows(row, columns, ("missing_dates", "invalid_dates"), {"missing_dates": "long", "invalid_dates": "long"})


def completeness(df: DataFrame, required: Sequence[str], key: str) -> DataFrame:
    """Share of filled required values, duplicate rows by key and their rate."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"), sum(F.count(c) for c in required).alias("_filled")
    )
    return per_key.agg(
        F.round(F.sum("_filled") * 100.0 / (F.sum("_rows") * len(required)), 4).alias("completeness_percent"),
        (F.sum("_rows") - F.count(F.lit(1))).alias("duplicate_count"),
        F.round(1 - F.count(F.lit(1)) / F.sum("_rows"), 6).alias("duplicate_rate"),
    )


def select_statistical_features(df: DataFrame, candidates: Sequence[str], minimum: int = 20) -> DataFrame:
    """Which numeric columns are fit for statistics, with the reason where not.

    Names are judged by whole words: identifiers, missing flags and counts, suppression marks. Then
    columns with at most two distinct values, too few values or no variance fall out.
    """

    def by_name(name: str) -> str | None:
        lower = name.lower()
        words = lower.split("_")
        if "id" in words:
            return "identifier"
        if "missing_flag" in lower or lower.endswith("_missing") or "_missing_" in lower and "count" not in words:
            return "missing_flag"
        if "suppressed" in words or "suppression" in words:
            return "suppressed"
        if any(k in lower for k in ("missing_count", "null_count", "na_count")):
            return "missing_count"
        return None

    row = df.agg(
        *[F.count(c).alias(f"{c}__filled") for c in candidates],
        *[F.var_samp(c).alias(f"{c}__variance") for c in candidates],
        *[F.min(c).cast("double").alias(f"{c}__low") for c in candidates],
        *[F.max(c).cast("double").alias(f"{c}__high") for c in candidates],
    )
    types = {"filled": "long", "variance": "double", "low": "double", "high": "double"}
    facts = wide_to_rows(row, candidates, tuple(types), types)
    # "At most two distinct values" without a distinct count: is any value strictly between the extremes?
    ends = with_scalars(df.select(*candidates), row.select(*[f"{c}__low" for c in candidates], *[f"{c}__high" for c in candidates]), "_e")
    between = ends.agg(*[
        F.max(flag((F.col(c) > F.col(f"_e.{c}__low")) & (F.col(c) < F.col(f"_e.{c}__high")))).alias(f"{c}__inner") for c in candidates
    ])
    inner = wide_to_rows(between, candidates, ("inner",), {"inner": "boolean"})
    named = {c: by_name(c) for c in candidates}
    reason_by_name = F.coalesce(*[F.when(F.col("column_name") == c, F.lit(r)) for c, r in named.items() if r], F.lit(None).cast("string"))
    reason = F.coalesce(
        reason_by_name,
        F.when(~flag(F.col("inner")), F.lit("binary_or_constant")),
        F.when((F.col("filled") < minimum) | ~flag(F.col("variance") > 0), F.lit("low_information")),
    )
    return facts.join(F.broadcast(inner), "column_name").select("column_name", "filled", reason.alias("excluded_because"), reason.isNull().alias("selected"))
