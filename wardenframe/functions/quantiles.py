"""Exact quantiles and exact running totals over globally ordered values, without one big task.

``percentile`` keeps every distinct value of a column in one hash map. That holds for columns with few
distinct values, whatever their number of rows. A column with more is narrowed first: a bounded sketch
proposes two values around each wanted rank, one pass counts the rows below and at them exactly, and the
rank goes on in the part that holds it, until the part has few distinct values. Both ways are exact and
agree; NaN counts as missing, as NULL does.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenframe.functions.columns import unpivot_numeric, with_scalars

#: Distinct values that are ordered together, parts of a narrowing step, accuracy of its sketch.
ORDERED_VALUES = 100_000
PARTS = 200
SKETCH_ACCURACY = 10_000


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per column: ``feature`` and ``q`` (array of exact quantiles in the order of ``probs``; NULL without values)."""
    labels = {f"q{i}": float(p) for i, p in enumerate(probs)}
    row = quantile_row(df, cols, labels)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.array(*[F.col(f"{c}__{k}") for k in labels]).alias("q")) for c in cols])
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """One row with a column ``<column>__<label>`` per column and labelled probability.

    Columns are worked on in long form, so each has its own group and task, and the plan does not grow with them.
    """
    labels, values = list(probs), [float(p) for p in probs.values()]
    cols = list(dict.fromkeys(cols))
    widths = {r["feature"]: r["n"] for r in _filled(df, cols).groupBy("feature").agg(F.approx_count_distinct("value").alias("n")).collect()}
    # The estimate errs by a few percent, so half the bound leaves room.
    wide = [c for c in cols if widths.get(c, 0) > ORDERED_VALUES // 2]
    found = _narrowed(unpivot_numeric(df, wide), values) if wide else {}
    narrow = [c for c in cols if c in widths and c not in found]
    if narrow:
        ordered = _filled(df, narrow).groupBy("feature").agg(F.percentile("value", F.array(*[F.lit(p) for p in values])).alias("q"))
        found |= {r["feature"]: r["q"] for r in ordered.collect()}
    row = tuple(None if c not in found else float(found[c][i]) for c in cols for i in range(len(labels)))
    return df.sparkSession.createDataFrame([row], T.StructType([T.StructField(f"{c}__{k}", T.DoubleType()) for c in cols for k in labels]))


def _filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form of the values that count."""
    return unpivot_numeric(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))


@dataclass(frozen=True)
class _Part:
    """Values of a column between two bounds (both included), with the exact number of values below."""

    feature: str
    low: float
    high: float
    below: int


def _narrowed(long: DataFrame, probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of columns with many distinct values. The driver holds a few numbers per column and probability."""
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = long.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    positions = {r["feature"]: [p * (r["n"] - 1) for p in probs] for r in stats}
    where = {(r["feature"], rank): _Part(r["feature"], r["low"], r["high"], 0) for r in stats for x in positions[r["feature"]] for rank in (math.floor(x), math.ceil(x))}
    known: dict[tuple[str, int], float] = {}
    small: set[_Part] = set()
    while open_ := sorted({k for k in where if k not in known and where[k] not in small}):
        _narrow(long, where, known, small, open_)
    _order(long, where, known)
    out = {}
    for feature, wanted in positions.items():
        pairs = [(known[feature, math.floor(x)], known[feature, math.ceil(x)], x - math.floor(x)) for x in wanted]
        out[feature] = [a if a == b else (1 - share) * a + share * b for a, b, share in pairs]
    return out


def _inside(long: DataFrame, parts: Sequence[_Part]) -> DataFrame:
    """Rows of ``long`` with the number of each part that holds them. The parts are few, so they are broadcast."""
    rows = [(i, p.feature, p.low, p.high) for i, p in enumerate(parts)]
    table = long.sparkSession.createDataFrame(rows, "part int, _f string, low double, high double")
    return long.join(F.broadcast(table), (F.col("feature") == F.col("_f")) & F.col("value").between(F.col("low"), F.col("high")))


def _narrow(long: DataFrame, where: dict, known: dict, small: set[_Part], open_: Sequence[tuple[str, int]]) -> None:
    """One step for the ranks of ``open_``: bounds from a sketch, exact counts, and the part that holds the rank."""
    parts = sorted({where[k] for k in open_}, key=lambda p: (p.feature, p.low, p.high))
    marked = _inside(long, parts)
    grid = [i / PARTS for i in range(1, PARTS)]
    cuts = {r["part"]: (r["n"], r["cuts"]) for r in marked.groupBy("part").agg(F.count("value").alias("n"), F.percentile_approx("value", grid, SKETCH_ACCURACY).alias("cuts")).collect()}
    tries: dict[int, list[tuple[float, float]]] = {}
    mine: dict[tuple[str, int], tuple[int, int]] = {}
    for k in open_:
        i, part = parts.index(where[k]), where[k]
        n, edges = cuts[i]
        at = (k[1] - part.below) * PARTS // max(n, 1)
        low, high = edges[max(at - 2, 0)] if at >= 2 else part.low, edges[at + 1] if at + 1 < len(edges) else part.high
        pairs = tries.setdefault(i, [])
        if (low, high) not in pairs:
            pairs.append((low, high))
        mine[k] = (i, pairs.index((low, high)))
    most = max(map(len, tries.values()))
    bounds = long.sparkSession.createDataFrame([(i, [a for a, _ in t], [b for _, b in t]) for i, t in tries.items()], "part int, lows array<double>, highs array<double>")
    v, at = F.col("value"), lambda name, j: F.get(F.col(name), j)
    counted = marked.join(F.broadcast(bounds), "part").groupBy("part").agg(*[
        c for j in range(most) for c in (
            F.count_if(v < at("lows", j)).alias(f"a{j}"), F.count_if(v <= at("lows", j)).alias(f"b{j}"), F.count_if(v < at("highs", j)).alias(f"c{j}"), F.count_if(v <= at("highs", j)).alias(f"d{j}"),
            F.approx_count_distinct(F.when((v > at("lows", j)) & (v < at("highs", j)), v)).alias(f"e{j}"),
        )
    ]).collect()
    counts = {r["part"]: r for r in counted}
    for k, (i, j) in mine.items():
        part, row = where[k], counts[i]
        low, high = tries[i][j]
        a, b, c, d = (part.below + row[f"{x}{j}"] for x in "abcd")
        if k[1] < a:
            where[k] = _Part(part.feature, part.low, math.nextafter(low, -math.inf), part.below)
        elif k[1] < b:
            known[k] = low
        elif k[1] < c:
            where[k] = _Part(part.feature, math.nextafter(low, math.inf), math.nextafter(high, -math.inf), b)
            if row[f"e{j}"] <= ORDERED_VALUES // 2:
                small.add(where[k])
        elif k[1] < d:
            known[k] = high
        else:
            where[k] = _Part(part.feature, math.nextafter(high, math.inf), part.high, d)


def _order(long: DataFrame, where: dict, known: dict) -> None:
    """Order the values of the parts that are small enough and read off the wanted ranks."""
    wanted = [k for k in where if k not in known]
    if not wanted:
        return
    parts = sorted({where[k] for k in wanted}, key=lambda p: (p.feature, p.low, p.high))
    ranks = long.sparkSession.createDataFrame([(i, p.below, sorted(k[1] for k in wanted if where[k] == p)) for i, p in enumerate(parts)], "part int, below long, ranks array<long>")
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ordered = _inside(long, parts).groupBy("part", "value").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", upto).join(F.broadcast(ranks), "part")
    last = F.col("below") + F.col("upto") - 1
    hits = ordered.select("part", "value", F.explode(F.filter("ranks", lambda r: (r <= last) & (r > last - F.col("c")))).alias("rank"))
    for r in hits.collect():
        known[parts[r["part"]].feature, r["rank"]] = r["value"]


def running_totals(values: DataFrame, order_by: str, weights: Sequence[str], buckets: int = 1000) -> DataFrame:
    """Exact inclusive running totals of ``weights`` along ``order_by``, which must be unique and non-NULL.

    The order is cut at sketch points, fetched once so that every branch sees the same cuts (at most
    ``buckets`` numbers). Each bucket is ordered by its own task and lifted by the total of the
    buckets before it (at most ``buckets`` rows, so that part is small by construction).
    """
    steps = [i / buckets for i in range(1, buckets)]
    sketch = values.agg(F.percentile_approx(F.col(order_by).cast("double"), steps, 10 * buckets).alias("cuts")).first()
    cuts = sorted(set(sketch.cuts or []))
    keyed = values.withColumn("_order", F.col(order_by).cast("double"))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        spread = Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket").transform(keyed)
    else:
        spread = keyed.withColumn("_bucket", F.lit(0.0))
    totals = spread.groupBy("_bucket").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(f"_{w}").over(before), F.lit(0)).alias(f"_{w}_before") for w in weights])
    inside = Window.partitionBy("_bucket").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.join(F.broadcast(offsets), "_bucket")
    return placed.select(
        *values.columns, *[(F.col(f"_{w}_before") + F.sum(w).over(inside)).alias(f"{w}_upto") for w in weights]
    )


def cumulative_share(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the percentage of rows at or below them (an exact ``cume_dist``)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("rows"))
    every = counted.agg(F.sum("rows").alias("n"))
    ordered = running_totals(counted, value, ["rows"])
    return with_scalars(ordered, every, "_all").select(value, (F.col("rows_upto") * 100.0 / F.col("_all.n")).alias("percentile_rank"))
