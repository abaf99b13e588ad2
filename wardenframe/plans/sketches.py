"""Queries of the profile store: order lines profiled by ship year and return flag, rolled up from what was kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag
from wardenframe.operators import profile_store as st
from wardenframe.plans.registry import query
from wardenframe.session import scratch_path
from wardenframe.sources.tables import read_table

PARTS = ("ship_year", "returnflag")
NUMERIC, CATEGORIES = ("quantity", "price", "discount"), ("status", "line")
QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
_SELECT = (
    "SELECT year(l_shipdate) AS ship_year, l_returnflag AS returnflag, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice AS price, l_discount AS discount, "
    "l_linestatus AS status, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber AS {text}) END AS line FROM lineitem"
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SELECT.format(text="STRING").replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, sf_dir, "lineitem"))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after two landings, of which the second brings a part again."""
    lines, path = _lines(spark, sf_dir), scratch_path(spark, "profile-store")
    st.write_parts(st.sketch_parts(lines.where("returnflag <> 'N'"), PARTS, NUMERIC, CATEGORIES), path, PARTS)
    st.write_parts(st.sketch_parts(lines.where("returnflag IN ('N', 'A')"), PARTS, NUMERIC, CATEGORIES), path, PARTS)
    return st.read_parts(spark, path)


_LONG = (
    f"WITH t AS ({_SELECT.format(text='VARCHAR')}), long AS ("
    + " UNION ALL ".join([f"SELECT ship_year, returnflag, '{c}' AS column_name, {c} AS x, CAST({c} AS VARCHAR) AS v FROM t" for c in NUMERIC] + [f"SELECT ship_year, returnflag, '{c}', NULL, {c} FROM t" for c in CATEGORIES])
    + ")"
)
_FACTS = (
    "count(*) AS rows, count(v) AS filled, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x < 0) AS negatives, min(x) AS low, max(x) AS high, count(*) - count(v) AS missing, "
    "round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std"
)
_SHOWN = ("column_name", "rows", "filled", "zeros", "negatives", "low", "high", "missing", "mean", "std")


@query("profile_store_rollup", "E3 E4 E11", _LONG + f" SELECT column_name, {_FACTS} FROM long GROUP BY column_name")
def profile_store_rollup(spark, sf_dir):
    return st.profile(st.roll_up(_store(spark, sf_dir)), QUANTILES).select(*_SHOWN)


@query("profile_store_years", "E3 A6", _LONG + f" SELECT ship_year, column_name, {_FACTS} FROM long GROUP BY ship_year, column_name")
def profile_store_years(spark, sf_dir):
    return st.profile(st.roll_up(_store(spark, sf_dir), ["ship_year"]), QUANTILES).select("ship_year", *_SHOWN)


@query(
    "profile_store_frequent", "E4 E12",
    _LONG + ", c AS (SELECT column_name, v AS value, count(*) AS rows FROM long WHERE v IS NOT NULL AND column_name IN ('status', 'line') GROUP BY ALL) SELECT column_name, value, rows FROM c",
)
def profile_store_frequent(spark, sf_dir):
    """Counts of all values of the narrow columns, by merged sketches."""
    found = st.frequent_values(st.roll_up(_store(spark, sf_dir)), 20)
    return found.where(F.col("column_name").isin(*CATEGORIES)).select("column_name", "value", "rows")


@query(
    "profile_store_errors", "E3 E11 H9",
    _LONG + " SELECT column_name, count(DISTINCT v) AS distinct_values, true AS distinct_close, " + ", ".join(f"count(x) > 0 AS {n}_close" for n in QUANTILES) + " FROM long GROUP BY column_name",
)
def profile_store_errors(spark, sf_dir):
    """Estimates of the rolled-up sketches against exact counts: distinct values, and the ranks between which each quantile's value lies."""
    lines = _lines(spark, sf_dir)
    estimated = st.profile(st.roll_up(_store(spark, sf_dir)), QUANTILES).select("column_name", F.col("distinct_values").alias("estimate"), *QUANTILES)
    long = st._long(lines, [], NUMERIC, "double").unionByName(st._long(lines, [], CATEGORIES, "string"))
    # Five columns, one row each.
    counted = long.where("text IS NOT NULL").groupBy("column_name", "number", "text").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(estimated), "column_name")
    sums = [F.sum(F.when(F.col("number") < F.col(q), F.col("n")).otherwise(0)).alias(f"{q}_below") for q in QUANTILES]
    sums += [F.sum(F.when(F.col("number") <= F.col(q), F.col("n")).otherwise(0)).alias(f"{q}_upto") for q in QUANTILES]
    facts = counted.groupBy("column_name").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct_values"), F.count("number").alias("numbers"), F.first("estimate").alias("estimate"), *sums)

    def close(q: str, p: float):
        low, high = F.col(f"{q}_below") / F.col("filled"), F.col(f"{q}_upto") / F.col("filled")
        return flag((F.col("numbers") > 0) & (low <= p + st.RANK_ERROR) & (high >= p - st.RANK_ERROR)).alias(f"{q}_close")

    near = F.abs(F.col("estimate") - F.col("distinct_values")) <= F.greatest(F.col("distinct_values") * st.DISTINCT_ERROR, F.lit(0.5))
    return facts.select("column_name", "distinct_values", near.alias("distinct_close"), *[close(q, p) for q, p in QUANTILES.items()])
