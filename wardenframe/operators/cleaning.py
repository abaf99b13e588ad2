"""Cleaning and preparation. Statistics are fitted as small tables and applied as expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardenframe.functions.columns import SUPPRESSION_TOKENS, col, finite, to_number, wide_to_rows, with_scalars
from wardenframe.functions.quantiles import quantile_row
from wardenframe.operators.profiling import correlation_matrix

MISSING_CATEGORY = "__MISSING__"
#: Columns from which on a table is wide, and how many of its columns are summed up together.
WIDE, STATS_AT_ONCE = 100, 32
# Text read as missing when a text column is tried as numbers.
NUMBER_BLANKS = ("", "nan", "None", "*", "**", "N/A", "NA")


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Safe cast of text columns to double."""
    return df.select(*[to_number(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def open_suppressed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Suppression tokens become NULL, remembered in ``<column>_suppressed``."""
    hidden = {c: F.coalesce(F.trim(c).isin(*SUPPRESSION_TOKENS), F.lit(False)) for c in columns}
    return df.select(
        *[F.when(~hidden[c], F.col(c)).alias(c) if c in hidden else F.col(c) for c in df.columns],
        *[hidden[c].cast("int").alias(f"{c}_suppressed") for c in columns],
    )


def suppression_summary(opened: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Suppressed cells per column."""
    row = opened.agg(
        *[F.sum(f"{c}_suppressed").alias(f"{c}__suppressed") for c in columns],
        *[F.round(F.avg(f"{c}_suppressed") * 100, 4).alias(f"{c}__suppressed_percent") for c in columns],
    )
    return wide_to_rows(row, columns, ("suppressed", "suppressed_percent"), {"suppressed": "long", "suppressed_percent": "double"})


def tidy_columns(df: DataFrame) -> DataFrame:
    """Trim column names, drop ``Unnamed`` columns and columns without any value."""
    named = df.toDF(*[c.strip() for c in df.columns])
    kept = [c for c in named.columns if not c.startswith("Unnamed")]
    filled = named.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in kept]).first()
    return named.select(*[f"`{c}`" for c in kept if filled[c] > 0])


def remove_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[finite(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def infinite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"{c}__infinite") for c in columns])
    return wide_to_rows(row, columns, ("infinite",), {"infinite": "long"})


def numeric_shares(df: DataFrame, columns: Sequence[str], share: float = 0.80) -> DataFrame:
    """Per text column: filled values, castable values and whether it counts as numeric."""

    def text(c: str):
        t = F.trim(F.col(c))
        return F.when(~t.isin(*NUMBER_BLANKS), t)

    row = df.agg(
        *[F.count(text(c)).alias(f"{c}__filled") for c in columns], *[F.count(to_number(text(c))).alias(f"{c}__numeric") for c in columns]
    )
    rows = wide_to_rows(row, columns, ("filled", "numeric"), {"filled": "long", "numeric": "long"})
    return rows.withColumn("is_numeric", (F.col("filled") > 0) & (F.col("numeric") >= share * F.col("filled")))


def auto_numeric(df: DataFrame, columns: Sequence[str], share: float = 0.80) -> DataFrame:
    """Cast the columns whose values are mostly numbers. One aggregate row decides."""
    chosen = {r.column_name for r in numeric_shares(df, columns, share).collect() if r.is_numeric}
    return numeric_columns(df, sorted(chosen))


def fit_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``<column>__median``, 0 where a column has no value."""
    row = quantile_row(df, columns, {"median": 0.5})
    return row.select(*[F.coalesce(F.col(f"{c}__median"), F.lit(0.0)).alias(f"{c}__median") for c in columns])


def impute(df: DataFrame, columns: Sequence[str], medians: DataFrame) -> DataFrame:
    filled = with_scalars(df, medians, "_m")
    return filled.select(*[F.coalesce(F.col(c), F.col(f"_m.{c}__median")).alias(c) if c in columns else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    # Of a wide table a few columns at a time: beyond a hundred Spark neither generates code nor reads columns in batches.
    step = max(len(columns), 1) if len(columns) <= WIDE else STATS_AT_ONCE
    groups = [columns[i:i + step] for i in range(0, len(columns), step)]
    stats = reduce(DataFrame.crossJoin, [df.agg(*[f(c).alias(f"{c}__{n}") for c in some for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]) for some in groups])
    wide = with_scalars(df, stats, "_s")
    scaled = {c: (F.col(c) - F.col(f"_s.{c}__mean")) / F.when(F.col(f"_s.{c}__sd") > 0, F.col(f"_s.{c}__sd")).otherwise(1.0) for c in columns}
    return wide.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / (q3 - q1); a column without spread is only centred."""
    stats = quantile_row(df, columns, {"q1": 0.25, "mid": 0.5, "q3": 0.75})
    wide = with_scalars(df, stats, "_s")

    def scaled(c: str):
        spread = F.col(f"_s.{c}__q3") - F.col(f"_s.{c}__q1")
        return (F.col(c) - F.col(f"_s.{c}__mid")) / F.when(spread > 0, spread).otherwise(1.0)

    return wide.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def category_text(c: str):
    """Missing values form their own category; text is compared trimmed and in lower case."""
    return F.trim(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))))


def fit_ordinals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, category, code)``: codes follow the sorted distinct categories of each column.

    Ranked in two steps (leading characters, then inside them), so a column with very many categories
    is ordered by many tasks. The order is the same: text sorts by its leading characters first.
    """
    long = df.select(*[category_text(c).alias(c) for c in columns]).unpivot([], list(columns), "column_name", "category").distinct()
    long = long.withColumn("_head", F.substring("category", 1, 3))
    heads = long.groupBy("column_name", "_head").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column_name").orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select("column_name", "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("column_name", "_head").orderBy("category")) - 1
    ranked = long.withColumn("_inside", inside).join(offsets, ["column_name", "_head"])
    return ranked.select("column_name", "category", (F.col("_before") + F.col("_inside")).cast("int").alias("code"))


def encode(df: DataFrame, columns: Sequence[str], codes: DataFrame) -> DataFrame:
    """Replace categories by their codes; unknown ones become -1."""
    out = df
    for c in columns:
        one = codes.where(F.col("column_name") == c).select(F.col("category").alias(f"_k_{c}"), F.col("code").alias(f"{c}_code"))
        out = out.join(one, category_text(c) == F.col(f"_k_{c}"), "left").drop(f"_k_{c}")
    return out.select(*df.columns, *[F.coalesce(F.col(f"{c}_code"), F.lit(-1)).alias(f"{c}_code") for c in columns])


def column_shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: distinct values, filled values, missing share. What constant and sparse checks read."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    counted = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    filled = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("rows"))), F.lit(0))
    return counted.groupBy("column_name").agg(
        F.count("value").alias("distinct_values"), filled.alias("filled"), F.round(1 - filled / F.sum("rows"), 6).alias("missing_rate")
    )


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A column whose least and greatest value agree carries no information (no distinct count needed)."""
    row = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c]])


def drop_sparse(df: DataFrame, columns: Sequence[str], limit: float = 0.98) -> DataFrame:
    row = df.agg(*[(F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is not None and row[c] >= limit])


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing_flag") for c in columns])


def correlated_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns to drop: each one that correlates above ``limit`` with an earlier column, over the rows that hold both."""
    matrix = correlation_matrix(df, columns)
    return [c for j, c in enumerate(columns) if any(abs(matrix[i][j]) > limit for i in range(j))]


def prefix(c: str, default: str = "OTHER"):
    """Leading letters of a code; missing codes have none."""
    found = F.regexp_extract(F.coalesce(col(c), F.lit(MISSING_CATEGORY)), "^([A-Za-z]+)", 1)
    return F.when(found == "", default).otherwise(found)


def fixed_layout(df: DataFrame, layout: Mapping[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and then the given columns in the given order; missing values take the given fill, absent columns 0."""
    return df.select(*keep, *[
        F.coalesce(F.col(c).cast("double"), F.lit(float(fill))).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c, fill in layout.items()
    ])
