"""Lloyd's clustering with the dimensions dealt out to shards, in exact integers.

Vectors are cut into blocks of rows, and every block into column blocks of `width` dimensions, written in
one folder per shard. In a round

1. a column-block task reads blocks of one shard and that shard's slice of the centroids, and gives the exact
   partial distance of every row to every centroid;
2. the partial distances of a block of rows are added by block, and the least sum names the cluster;
3. sums and counts of each shard's columns by cluster meet under (shard, cluster, dimension), where the slice
   of that shard moves.

Nothing but column blocks, partial distances and sums travels; the centroids are a written table of
clusters x dimensions numbers, of which a task sees its shard's slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import fresh_path, saved, table

#: Of the query: centroids, rounds, dimensions, factor of the integers, dimensions of a shard.
CLUSTERS, ROUNDS, DIMENSIONS, SCALE, WIDTH = 40, 5, 64, 256, 32
#: Rows of a block.
BLOCK_ROWS = 1024


def largest_component(dims: int) -> int:
    """Largest size of a component with which a squared distance still fits in a long."""
    return int((2**63 / (4 * dims)) ** 0.5) - 1


def integer_vectors(vector: Column, dims: int, scale: int = SCALE) -> tuple[Column, Column]:
    """(whether a vector has `dims` components that are neither null nor infinite nor NaN, its components as integers)."""
    fine = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = largest_component(dims)

    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double")) * scale <= most, y.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return F.coalesce(fine, F.lit(False)), F.transform(vector, whole)


def _cut(dims: int, width: int, kind: pa.DataType):
    """Blocks of rows, cut into the shards' columns; keys go with the first shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dims)
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = values[low: low + BLOCK_ROWS]
                shards = range(0, dims, width)
                data = [np.ascontiguousarray(part[:, s: s + width]).tobytes() for s in shards]
                keys = [batch.column("key").slice(low, len(part)).to_pylist(), *[None] * (len(data) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(data), pa.int64()), pa.array([len(part)] * len(data), pa.int32()), pa.array(keys, pa.list_(kind)), pa.array(data, pa.binary()), pa.array(range(len(data)), pa.int32())],
                    names=["block", "rows", "keys", "data", "shard"],
                )
                block += 1
    return run


def partial_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, as exact 64-bit integers, of every point to every centre."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centres).max(initial=0)))
    # Floating-point products are exact as long as no sum passes 2**53.
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    points, centres = points.astype(kind), centres.astype(kind)
    return ((points * points).sum(1)[:, None] - 2 * (points @ centres.T) + (centres * centres).sum(1)).astype(np.int64)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial distances of column blocks to their shard's slice, above the least of each row and by significance of their bytes."""
    for batch in batches:
        found = []
        for rows, data, values, clusters in zip(*(batch.column(c).to_pylist() for c in ("rows", "data", "slice", "clusters"))):
            points = np.frombuffer(data, "<i4").reshape(rows, -1)
            far = partial_distances(points, np.array(values, np.int64).reshape(clusters, -1))
            least = far.min(axis=1)
            above = far - least[:, None]
            used = max(1, (int(above.max()).bit_length() + 7) // 8)
            planes = np.ascontiguousarray(above.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used].T)
            found.append(least.astype("<i8").tobytes() + planes.tobytes())
        columns = {c: batch.column(c) for c in batch.schema.names if c not in ("slice",)} | {"partial": pa.array(found, pa.binary())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _added(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every row of a block, from the partial distances of its column blocks."""
    count, clusters = rows["rows"][0].as_py(), rows["clusters"][0].as_py()
    total = np.zeros((count, clusters), np.int64)
    for packed in rows["partial"].to_pylist():
        least = np.frombuffer(packed, "<i8", count)
        planes = np.frombuffer(packed, np.uint8, offset=8 * count).reshape(-1, count * clusters)
        above = np.zeros((count * clusters, 8), np.uint8)
        above[:, : len(planes)] = planes.T
        total += above.view("<i8").reshape(count, clusters) + least[:, None]
    cluster = total.argmin(axis=1)  # the first of equals
    return cluster, total[np.arange(count), cluster]


def _sums(width: int):
    def run(rows: pa.Table) -> pa.Table:
        cluster, _ = _added(rows)
        order = np.argsort(cluster, kind="stable")
        present, first, members = np.unique(cluster[order], return_index=True, return_counts=True)
        out = []
        for shard, data in zip(rows["shard"].to_pylist(), rows["data"].to_pylist()):
            points = np.frombuffer(data, "<i4").reshape(len(cluster), -1).astype(np.int64)
            sums = np.add.reduceat(points[order], first, axis=0)
            k, d = np.divmod(np.arange(sums.size), points.shape[1])
            out.append(np.column_stack([np.full(sums.size, shard), present[k], shard * width + d, sums.ravel(), members[k]]))
        found = np.concatenate(out)
        return pa.table({n: pa.array(np.ascontiguousarray(found[:, k])) for k, n in enumerate(("shard", "cluster", "dim", "total", "members"))})
    return run


def _assigned(kind: pa.DataType):
    def run(rows: pa.Table) -> pa.Table:
        cluster, distance = _added(rows)
        keys = next(k for k in rows["keys"].to_pylist() if k is not None)
        return pa.table({"key": pa.array(keys, kind), "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})
    return run


def lloyd_by_columns(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = "2") -> tuple[DataFrame, DataFrame]:
    """(`key`, `cluster`, `distance` of every usable vector; `cluster`, `dim`, `value` of the final centroids).

    Vectors with another number of components than `dims`, or with a null, NaN or infinite one, are left out;
    so are null vectors. Components become floor(scale * x). The first centroids are the vectors with the least
    sha256 of `seed:key` (null keys last; equal keys by their components), as many as there are at most. In a
    round every vector goes to its nearest centroid (ties: the smaller number), and every centroid that has
    vectors to the floor of their mean; after the last round vectors are assigned once more. Repeated rows and
    keys count one by one; an empty table gives two empty ones; other columns are not read. A component too
    large for exact distances in a long is an error.
    """
    spark = df.sparkSession
    fine, whole = integer_vectors(F.col(vector), dims, scale)
    rows = df.filter(fine).select(F.col(key).alias("key"), whole.alias("x"))
    kind = rows.schema["key"].dataType.simpleString()
    first = rows.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters)
    # Clusters x dimensions numbers: the start of a table that has this size in every round.
    start = [(c, d, int(v)) for c, row in enumerate(first.select("x").collect()) for d, v in enumerate(row["x"])]
    centroids = saved(spark.createDataFrame(start, "cluster int, dim int, value long"), "centroids")
    if not start:
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    arrow = rows.limit(0).select("key").toArrow().schema.field("key").type

    path = fresh_path(spark, "column-blocks")
    schema = f"block long, rows int, keys array<{kind}>, data binary, shard int"
    rows.mapInArrow(_cut(dims, width, arrow), schema).write.partitionBy("shard").parquet(path)
    blocks = spark.read.schema(schema).parquet(path)

    def partials(now: DataFrame, keys: bool) -> DataFrame:
        entry = F.struct("cluster", "dim", "value")
        slices = now.groupBy(F.expr(f"dim div {width}").cast("int").alias("shard")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["value"]).alias("slice"), F.countDistinct("cluster").cast("int").alias("clusters"))
        # The broadcast side holds clusters x dimensions numbers, whatever the rows.
        joined = (blocks if keys else blocks.drop("keys")).join(F.broadcast(slices), "shard")
        carried = [c for c in joined.columns if c != "slice" and not (keys and c == "data")]
        out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in [*carried, "data"])
        return joined.mapInArrow(_partials, f"{out}, partial binary").select(*carried, "partial")

    for _ in range(rounds):
        moved = partials(centroids, keys=False).groupBy("block").applyInArrow(_sums(width), "shard long, cluster long, dim long, total long, members long")
        moved = moved.groupBy("shard", "cluster", "dim").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
        mean = F.expr("(total - pmod(total, members)) div members")
        moved = moved.select(F.col("cluster").cast("int").alias("cluster"), F.col("dim").cast("int").alias("dim"), mean.alias("mean"))
        centroids = saved(centroids.join(F.broadcast(moved), ["cluster", "dim"], "left").select("cluster", "dim", F.coalesce("mean", "value").alias("value")), "centroids")
    found = partials(centroids, keys=True).groupBy("block").applyInArrow(_assigned(arrow), f"key {kind}, cluster int, distance long")
    return saved(found, "assigned").withColumnRenamed("key", key), centroids


def op11_dimension_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = lloyd_by_columns(table(spark, sf_dir, "embeddings"))
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # At most one row per cluster, whatever the vectors.
    by_cluster = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"), F.collect_list(F.struct("cluster", "cluster_inertia")).alias("all")).select("inertia", F.inline("all"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda e: e["value"].cast("string"))
    digests = centroids.groupBy("cluster").agg(F.sha2(F.concat_ws(",", values).cast("binary"), 256).alias("centroid_sha256"))
    named = by_cluster.join(F.broadcast(digests), "cluster")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds written out one after the other."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1)::INT AS k, x AS c FROM v QUALIFY k < {CLUSTERS})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
d{n} AS MATERIALIZED (SELECT r, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{n}),
a{n} AS MATERIALIZED (SELECT r, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < ROUNDS:
            steps.append(f"""
s{n} AS (SELECT k, i, sum(x[i])::BIGINT AS s, count(*) AS m FROM a{n} JOIN v USING (r) CROSS JOIN (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT k, coalesce(n.c, o.c) AS c FROM c{n} o LEFT JOIN (SELECT k, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM s{n} GROUP BY k) n USING (k))""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, k AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (k)
"""


OP11_SQL = _sql()
