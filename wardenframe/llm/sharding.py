"""Hilbert-curve sharding: rows sorted along a space-filling curve over metadata and cut into runs.

Every dimension is quantised to `2**bits` steps at its own quantiles (of texts: exact ones of the whole texts), the steps are turned into a curve
index, and the rows in curve order are cut into shards of equal row counts. Files written per shard then
cover small boxes of the metadata space, so a filter on any of the dimensions skips most of them.

Only DataFrame functions run. The order inside a curve cell is that of a hash, so a cell of any size
(one source with a third of the rows, a large group of copies) is dealt over `SALTS` groups; positions
come from counts per group and two small running totals, never from one window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenframe.llm.common import saved, shuffle_partitions, table

SALTS = 256
#: Accuracy of the quantile sketch of numbers; its size, not that of the data, bounds what a task holds.
SKETCH = 2000


def ordinal(df: DataFrame, name: str) -> Column:
    """Numbers as they are; anything else by the bytes of its whole text. Null sorts first."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(float("-inf")))
    whole = F.concat(F.lit("1").cast("binary"), F.col(name).cast("string").cast("binary"))
    return F.coalesce(whole, F.lit("0").cast("binary"))


def text_cuts(rows: DataFrame, name: str, total: int, steps: int) -> list[bytes]:
    """Values of a binary column at its exact `steps`-quantiles: the `steps - 1` or fewer that the running total of rows reaches them with.

    The distinct values, however many, are dealt by range; only the totals of the ranges are added up in one task.
    """
    counted = rows.groupBy(name).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(shuffle_partitions(rows.sparkSession), name).withColumn("_range", F.spark_partition_id())
    ranged = saved(ranged, "hilbert-values")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy("_range").agg(F.sum("n").alias("m")).select("_range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("_range").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(ahead), "_range").withColumn("upto", F.col("ahead") + F.sum("n").over(inside))
    reached, missed = (F.expr(f"least({rank} * {steps} div {max(total, 1)}, {steps - 1})") for rank in ("upto", "(upto - n)"))
    return sorted(bytes(r[0]) for r in placed.filter(reached > missed).select(name).collect())


def curve_index(steps: Column, dimensions: int, bits: int) -> Column:
    """Hilbert index of an array of `dimensions` whole numbers below `2**bits`."""
    moves = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(dimensions)]
    plan = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in moves]) if moves else None

    def unwind(x: Column, move: Column) -> Column:
        q, i = move["q"], move["i"]
        low = q - 1
        mine = F.get(x, i)
        swap = (F.get(x, 0).bitwiseXOR(mine)).bitwiseAND(low)
        return F.when(
            mine.bitwiseAND(q) != 0, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)),
        ).otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), F.when(i == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)))

    turned = F.aggregate(plan, steps, unwind) if moves else steps
    gray = F.transform(turned, lambda v, j: F.aggregate(F.slice(turned, 1, j + 1), F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(w)))
    last = F.get(gray, dimensions - 1)
    fold = F.aggregate(
        F.array(*[F.lit(1 << b).cast("long") for b in range(1, bits)]) if bits > 1 else F.array().cast("array<long>"),
        F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    final = F.transform(gray, lambda v: v.bitwiseXOR(fold))
    out = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dimensions)])
    # Every level gives one bit of each dimension, most significant first.
    return F.aggregate(out, F.lit(0).cast("long"), lambda a, m: a * 2 + F.when(F.get(final, m["i"]).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b).cast("long") for b in range(bits)]), m["b"] + 1)) != 0, 1).otherwise(0))


def hilbert_shards(
    df: DataFrame, dimensions: list[str], key: str, shards: int, payload: dict[str, Column] | None = None, bits: int = 4,
) -> DataFrame:
    """Key, `payload` columns, `curve` (index), `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard) of every row.

    Row counts of shards differ by one at most. Equal rows (also repeated keys) get neighbouring slots in
    any order; nulls form the first step of their dimension; an empty table gives no rows. Other columns of
    `df`, whatever their names, are not read. `bits * len(dimensions)` must not exceed 20: it bounds the
    number of curve cells.
    """
    if bits * len(dimensions) > 20 or not dimensions:
        raise ValueError("between one dimension and 20 bits in all")
    rows = df.select(
        F.col(key).alias("_key"),
        *[ordinal(df, c).alias(f"_d{k}") for k, c in enumerate(dimensions)],
        *[c.alias(f"_p{k}") for k, c in enumerate((payload or {}).values())],
    )
    rows = rows.withColumn("_h", F.xxhash64("_key", *[f"_p{k}" for k in range(len(payload or {}))]))
    rows = saved(rows, "hilbert-rows")
    total = rows.count()
    share = [s / (1 << bits) for s in range(1, 1 << bits)]
    texts = [k for k in range(len(dimensions)) if isinstance(rows.schema[f"_d{k}"].dataType, T.BinaryType)]
    numbers = [k for k in range(len(dimensions)) if k not in texts]
    cuts = {k: text_cuts(rows, f"_d{k}", total, 1 << bits) for k in texts}
    if numbers:
        found = rows.agg(*[F.percentile_approx(f"_d{k}", share, SKETCH) for k in numbers]).first()
        cuts |= {k: sorted(set(c or [])) for k, c in zip(numbers, found)}

    def step(k: int) -> Column:
        return sum((F.when(F.col(f"_d{k}") > F.lit(b), 1).otherwise(0) for b in cuts[k]), F.lit(0)).cast("long")

    rows = rows.withColumn("_cell", F.array(*[step(k) for k in range(len(dimensions))])).withColumn("_salt", F.shiftright("_h", 40).bitwiseAND(SALTS - 1).cast("int"))
    rows = rows.drop(*[f"_d{k}" for k in range(len(dimensions))])
    groups = rows.groupBy("_cell", "_salt").agg(F.count("*").alias("n"))
    cells = groups.groupBy("_cell").agg(F.sum("n").alias("n")).withColumn("curve", curve_index(F.col("_cell"), len(dimensions), bits))
    # At most 2**(bits * dimensions) cells, whatever the table's size: one small running total.
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_cell", "curve", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("_cell").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("_cell", "_salt", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside")).join(cells, "_cell").select("_cell", "_salt", "curve", (F.col("ahead") + F.col("inside")).alias("start"))
    order = Window.partitionBy("_cell", "_salt").orderBy("_h", "_key")
    placed = rows.withColumn("_n", F.row_number().over(order)).join(starts, ["_cell", "_salt"]).withColumn("_rank", F.col("start") + F.col("_n") - 1)
    shard = F.expr(f"_rank * {shards} div {max(total, 1)}")
    placed = placed.withColumn("_shard", shard.cast("int")).withColumn("_first", F.expr(f"(cast(_shard as bigint) * {total} + {shards - 1}) div {shards}"))
    return placed.select(
        F.col("_key").alias(key), *[F.col(f"_p{k}").alias(n) for k, n in enumerate(payload or {})],
        "curve", F.col("_shard").alias("shard"), (F.col("_rank") - F.col("_first")).alias("slot"),
    )


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards along the curve over source, language and length; law `rows`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = hilbert_shards(docs, ["source", "lang", "n_chars"], "doc_id", 16, {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
