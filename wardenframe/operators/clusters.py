"""K-means peer groups with distance to the own centre.

All starts advance in the same passes over the rows: a task holds the centres of every start, gives each row to the nearest
centre of each, and returns sums and counts; starts that stand still drop out. The number of jobs is that of the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenframe.functions.columns import with_scalars
from wardenframe.functions.quantiles import quantile_row
from wardenframe.operators.serving import min_max
from wardenframe.session import materialise

#: Rows, chosen by hash, on which the centres of all starts are chosen and settled first; a centre that moves less far stands still.
SEED_ROWS, STILL = 4096, 1e-4
#: Rows of a task that deals them out before the rounds, where there are more than that; rows of a block, which is one value of a round's table; rows of a
#: product, whose results stay in the cache.
ROWS_PER_TASK, BLOCK_ROWS, PRODUCT_ROWS = 20_000, 4096, 1024
#: How blocks of larger tables are compressed; tasks whose sums are fetched one by one.
CODEC, PARTS_FETCHED = "lz4", 64


@dataclass(frozen=True)
class PeerGroups:
    """Centres of the groups, and the squared distances of all rows to their own, summed."""

    centres: np.ndarray
    cost: float

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def _numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as numbers; a missing or infinite one is an error."""
    def filled(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.raise_error(F.lit(f"{c} is not filled")).cast("double")).alias(c)
    return df.select(*[filled(c) for c in features])


def _spread_out(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre is a row, likelier the farther it is from those chosen."""
    chosen = [rows[rng.integers(len(rows))]]
    gap = ((rows - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and gap.sum() > 0:
        chosen.append(rows[rng.choice(len(rows), p=gap / gap.sum())])
        gap = np.minimum(gap, ((rows - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre."""
    far = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return far.argmin(axis=1)


def _mark_least(far: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The least value of each column; ``mark`` gets 1 at the first row that has it, 0 elsewhere."""
    least = far.min(axis=0)
    np.equal(far, least, out=mark)
    if np.count_nonzero(mark) != len(least):
        mark[:] = 0
        mark[far.argmin(axis=0), np.arange(len(least))] = 1
    return least


def _unlike(starts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The first of the starts that have the same centres in any order; the others would take the same way."""
    first: dict[bytes, int] = {}
    for s, c in starts.items():
        first.setdefault(c[np.lexsort(c.T[::-1])].tobytes(), s)
    return {s: starts[s] for s in first.values()}


def _moved(old: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Centres in the middle of their rows; one without rows stays."""
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)


def _summed(own: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows by group, each in the order of the rows."""
    wide = rows.shape[1]
    at = (own[:, None] * wide + np.arange(wide)).ravel()
    return np.bincount(at, rows.ravel(), groups * wide).reshape(groups, wide)


def _still(old: np.ndarray, new: np.ndarray) -> bool:
    return bool((np.sqrt(((new - old) ** 2).sum(axis=1)) <= STILL).all())


def _settled(rows: np.ndarray, centres: np.ndarray, max_iter: int) -> np.ndarray:
    """Where the centres come to rest on the bounded rows, so that few rounds over all rows are left."""
    for _ in range(max_iter):
        own = _nearest(rows, centres)
        counts = np.bincount(own, minlength=len(centres))
        new = _moved(centres, _summed(own, rows, len(centres)), counts)
        if _still(centres, new):
            return new
        centres = new
    return centres


def _blocks(data: DataFrame, packed: bool = False) -> DataFrame:
    """The rows as blocks of doubles, written once. A round then hands Python a few large values instead of each number by itself, which took most of its time.

    On their way to Python the bytes of a large table cost more than the products, so packed blocks are compressed. They lie column by column, where
    neighbours are alike, and are as small as a product, so that what has been unpacked is still in the cache.
    """
    wide = len(data.columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns]).reshape(wide, -1)
            step = PRODUCT_ROWS if packed else BLOCK_ROWS
            parts = [x[:, i:i + step] for i in range(0, x.shape[1], step)]
            if packed:
                blocks = [pa.compress(p.tobytes(), CODEC, asbytes=True) for p in parts]
                yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.binary()), "rows": pa.array([p.shape[1] for p in parts], pa.int32()), "length": pa.array([float((p * p).sum()) for p in parts], pa.float64())})
            else:
                yield pa.RecordBatch.from_pydict({"block": pa.array([p.T.tobytes() for p in parts], pa.binary())})

    blocks = data.mapInArrow(pack, "block binary, rows int, length double" if packed else "block binary")
    if packed:  # the parts of the table need not be of one size; packed they are dealt out cheaply
        blocks = blocks.repartition(data.sparkSession.sparkContext.defaultParallelism)
    return materialise(blocks, "cluster-blocks")


def _pieces(block: Row, wide: int) -> Iterator[tuple[np.ndarray, float]]:
    """The rows of a block, a column per row, as many at a time as a product takes, with the sum of their squares."""
    if len(block) > 1:
        data, rows, length = block
        yield np.frombuffer(pa.decompress(pa.py_buffer(data), wide * rows * 8, CODEC)).reshape(wide, rows), length
        return
    rows = np.frombuffer(block[0]).reshape(-1, wide)
    for i in range(0, len(rows), PRODUCT_ROWS):
        x = rows[i:i + PRODUCT_ROWS]
        yield x.T, float((x * x).sum())


def _round(blocks: DataFrame | RDD, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, float]]:
    """By start: sums and counts of the rows of each centre, and the cost of the centres that went in."""
    stacked = np.concatenate(list(centres.values()))
    away, half = -stacked, (stacked * stacked).sum(axis=1)[:, None] / 2
    ends = np.cumsum([len(c) for c in centres.values()])
    spans = list(zip((0, *ends[:-1]), ends))

    def run(rows: Iterator[Row]) -> Iterator[np.ndarray]:
        sums = np.zeros((len(stacked), stacked.shape[1] + 2))
        space = np.empty((2, len(stacked) * PRODUCT_ROWS))  # filled anew for every few rows, so that it stays in the cache
        for x, length in (p for r in rows for p in _pieces(r, stacked.shape[1])):
            near, mine = (s[:len(stacked) * x.shape[1]].reshape(len(stacked), -1) for s in space)
            # Half the squared distance without the row's own length, to the centres of all starts in one product.
            np.matmul(away, x, out=near)
            near += half
            for first, end in spans:
                sums[first, -1] += length + 2 * _mark_least(near[first:end], mine[first:end]).sum()
            sums[:, :-2] += mine @ x.T
            sums[:, -2] += mine.sum(axis=1)
        yield sums

    parts = (blocks.rdd if isinstance(blocks, DataFrame) else blocks).mapPartitions(run)
    # Starts x groups x features numbers; those of many tasks are added up by tasks.
    totals = parts.treeReduce(np.add) if parts.getNumPartitions() > PARTS_FETCHED else sum(parts.collect())
    by_start = {s: totals[first:end] for s, (first, end) in zip(centres, spans)}
    return {s: t[:, :-2] for s, t in by_start.items()}, {s: t[:, -2] for s, t in by_start.items()}, {s: max(float(t[:, -1].sum()), 0.0) for s, t in by_start.items()}


def fit_clusters(df: DataFrame, features: Sequence[str], k: int = 5, starts: int = 10, max_iter: int = 300, seed: int = 42) -> PeerGroups:
    """Best of ``starts`` runs by cost. Features must be filled; of fewer distinct rows than ``k`` each is a centre."""
    data = _numbers(df, features)
    total, cores = max(df.count(), 1), df.sparkSession.sparkContext.defaultParallelism
    if total <= ROWS_PER_TASK:
        data = materialise(data, "cluster-rows")
    elif len(df.inputFiles()) < cores:
        # As they lie, a whole table may be in one file, which one task would pack into blocks.
        data = materialise(data.repartition(max(cores, -(-total // ROWS_PER_TASK))), "cluster-rows")
    share = int(min(1.0, 2 * SEED_ROWS / total) * (1 << 20))
    near = data.where(F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(1 << 20)) < share).orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(SEED_ROWS)
    rows = np.array([list(r) for r in near.collect()], float).reshape(-1, len(features))
    if not len(rows):
        raise ValueError("no rows to cluster")
    moving = _unlike({s: _settled(rows, _spread_out(rows, k, np.random.default_rng(seed + s)), max_iter) for s in range(starts)})
    # Kept as bytes between the rounds, which would take longer over reading them than over the products; what is lost is read from the written blocks.
    blocks = _blocks(data, packed=total > ROWS_PER_TASK).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    done: dict[int, tuple[float, np.ndarray]] = {}
    for n in range(max_iter + 1):
        sums, counts, costs = _round(blocks, moving)
        for s in list(moving):
            old = moving[s]
            new = _moved(old, sums[s], counts[s])
            done[s] = (costs[s], old)
            if n == max_iter or _still(old, new):
                del moving[s]
            else:
                moving[s] = new
        if not moving:
            break
    blocks.unpersist()
    cost, centres = min(done.values(), key=lambda d: d[0])
    return PeerGroups(centres, cost)


def assign(df: DataFrame, model: PeerGroups, features: Sequence[str], keep: Sequence[str], anomaly_quantile: float | None = None) -> DataFrame:
    """Cluster, distance to its centre, distance scaled to 0..1 and (off by default) a distance flag."""
    names = [f"_f{i}" for i in range(len(features))]
    rows = df.select(*keep, *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
    kept = T.StructType([f for f in rows.schema.fields if f.name not in names])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = np.zeros((len(model.centres), batch.num_rows))
            known = np.ones(batch.num_rows, bool)
            for n, values in zip(names, model.centres.T):
                column = batch.column(n)
                x = column.to_numpy(zero_copy_only=False)
                if column.null_count:
                    known &= column.is_valid().to_numpy(zero_copy_only=False)
                gaps += (x - values[:, None]) ** 2
            nearest = gaps.argmin(axis=0)
            distance = pa.array(np.sqrt(gaps[nearest, np.arange(len(nearest))]), mask=~known)
            found = {c: batch.column(c) for c in kept.names} | {"cluster_id": pa.array(nearest.astype(np.int32)), "cluster_distance": distance}
            yield pa.RecordBatch.from_pydict(found)

    schema = T.StructType([*kept.fields, T.StructField("cluster_id", T.IntegerType()), T.StructField("cluster_distance", T.DoubleType())])
    # Written once: the range and the quantile take several passes over the distances.
    distances = materialise(rows.mapInArrow(place, schema), "cluster-distances")
    near = min_max(distances, "cluster_distance", "cluster_anomaly_score")
    if anomaly_quantile is None:
        return near.withColumn("cluster_anomaly", F.lit(False))
    cut = with_scalars(near, quantile_row(near, ["cluster_distance"], {"cut": anomaly_quantile}), "_c")
    return cut.select(*near.columns, (F.col("cluster_distance") > F.col("_c.cluster_distance__cut")).alias("cluster_anomaly"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("record_count"))


def join_model_results(forest: DataFrame, clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forest and cluster results of the same records, by key; raises when a record lacks a partner."""
    joined = forest.withColumn("_f", F.lit(1)).join(clusters.withColumn("_c", F.lit(1)), list(keys), "full_outer")
    paired = F.col("_f").isNotNull() & F.col("_c").isNotNull()
    checked = F.when(paired, F.lit(True)).otherwise(F.raise_error(F.lit("model results do not cover the same records")).cast("boolean"))
    return joined.withColumn("paired", checked).where("paired").drop("_f", "_c", "paired")
