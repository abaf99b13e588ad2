"""Column profiles kept as mergeable sketches: one row per part (a file, a year) and column.

A part is profiled once, when it lands. Profiles of any set of parts are rolled up from the kept rows alone: counts,
extremes and moments exactly, distinct values, quantiles and frequent values by merging sketches of fixed size. A part
that is profiled again replaces its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.operators.profiling import STAT_DIGITS

#: log2 of the registers of a distinct-count sketch (standard error 1.04 / sqrt(registers)), size of a quantile sketch
#: (its rank error is about 2.3 / size**0.9), values that a frequency sketch tracks.
HLL_BITS, KLL_SIZE, TRACKED = 12, 400, 1000
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL_BITS / 2)
RANK_ERROR = 3 * 2.3 / KLL_SIZE**0.9


def _long(df: DataFrame, parts: Sequence[str], columns: Sequence[str], kind: str) -> DataFrame:
    cells = df.select(*parts, *[F.col(c).cast(kind).alias(c) for c in columns]).unpivot(list(parts), list(columns), "column_name", "value")
    number = kind == "double"
    value = F.when(~F.isnan("value"), F.col("value") + F.lit(0.0)) if number else F.col("value")  # NaN is missing, and there is one zero
    return cells.select(*parts, "column_name", (value if number else F.lit(None).cast("double")).alias("number"), value.cast("string").alias("text"))


def sketch_parts(df: DataFrame, parts: Sequence[str], numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """One row per part and column: exact counts and moments, and the sketches as binary."""
    frames = [_long(df, parts, columns, kind) for columns, kind in ((numeric, "double"), (categories, "string")) if columns]
    x = F.col("number")
    return reduce(DataFrame.unionByName, frames).groupBy(*parts, "column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("text").alias("filled"), F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"),
        F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("spread"),
        F.hll_sketch_agg("text", HLL_BITS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(x, KLL_SIZE).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(text, {TRACKED})").alias("frequency_sketch"),
    )


def write_parts(sketches: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Add the parts to a store, one folder each; those that it holds already are replaced."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def roll_up(store: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of all parts that agree in ``by`` (none: of the whole store) from their kept rows; itself a store."""
    weighted = store.withColumn("_filled", F.when(F.col("mean").isNotNull(), F.col("filled")))
    total, at = F.sum("_filled"), F.sum(F.col("_filled") * F.col("mean"))
    mean = at / total
    # Spread of the parts, and of their means around the common one.
    spread = F.sum("spread") + F.greatest(F.sum(F.col("_filled") * F.col("mean") * F.col("mean")) - at * mean, F.lit(0.0))
    return weighted.groupBy(*by, "column_name").agg(
        *[F.sum(c).alias(c) for c in ("rows", "filled", "zeros", "negatives")], F.min("low").alias("low"), F.max("high").alias("high"), mean.alias("mean"), spread.alias("spread"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.expr(f"approx_top_k_combine(frequency_sketch, {TRACKED})").alias("frequency_sketch"),
    )


def profile(store: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """Readable profile of each row of a store: exact statistics, estimated distinct values and quantiles."""
    def quantile(p: float) -> Column:
        return F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(p)))

    sketches = ("distinct_sketch", "quantile_sketch", "frequency_sketch", "spread", "mean")
    std = F.sqrt(F.try_divide(F.col("spread"), F.col("filled") - 1))
    return store.select(
        *[c for c in store.columns if c not in sketches], (F.col("rows") - F.col("filled")).alias("missing"), F.round("mean", STAT_DIGITS).alias("mean"), F.round(std, STAT_DIGITS).alias("std"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"), *[quantile(p).alias(name) for name, p in quantiles.items()],
    )


def frequent_values(store: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent values of each row of a store with their counts, which are exact where a column has few distinct values."""
    measures = ("rows", "filled", "zeros", "negatives", "low", "high", "mean", "spread", "distinct_sketch", "quantile_sketch", "frequency_sketch")
    keys = [c for c in store.columns if c not in measures]
    # Missing values are counted in the sketch as a value of their own, which is left out here.
    entries = F.slice(F.filter(F.expr(f"approx_top_k_estimate(frequency_sketch, {top + 1})"), lambda e: e["item"].isNotNull()), 1, top)
    found = store.select(*keys, F.posexplode(entries).alias("rank", "entry"))
    return found.select(*keys, (F.col("rank") + 1).alias("rank"), F.col("entry.item").alias("value"), F.col("entry.count").alias("rows"))
