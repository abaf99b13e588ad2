"""Connected components of an edge table.

Every task first replaces the edges that it reads by a spanning forest of stars, which ties the same nodes with fewer
edges. What is left is finished by one task if it is small (its size is counted first), and otherwise by alternating
large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenframe.llm.common import saved

#: Rounds after which a graph that still changes is reported; each round halves long paths, so none needs as many.
MOST_ROUNDS = 60
#: Edges that are tied up together in a task's memory, and so many at most are finished by one task.
CHUNK_EDGES, ONE_TASK_EDGES = 1 << 18, 1 << 18


def forest(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For every node its root: the least node of its component."""
    root = np.arange(count)
    while len(left):
        one, other = root[left], root[right]
        # Only roots are hooked, each to the least that it meets; edges whose ends still differ come again.
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root != (above := root[root])).any():
            root = above
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    return root


def _stars_of(batches: list[pa.RecordBatch], loops: bool) -> pa.RecordBatch:
    """(u, v): every node of the edges with the least node of its component; roots with themselves only with `loops`."""
    table = pa.Table.from_batches(batches)
    both = pa.chunked_array([*table["u"].chunks, *table["v"].chunks], table["u"].type)
    nodes = pc.unique(both)
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(both, nodes).combine_chunks().to_numpy().astype(np.int64)
    root = forest(len(nodes), at[: len(table)], at[len(table):])
    named = np.arange(len(nodes)) if loops else np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(named)), nodes.take(pa.array(root[named]))], names=["u", "v"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_EDGES:
            yield _stars_of(held, loops=False)
            held = []
    if held:
        yield _stars_of(held, loops=False)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        yield _stars_of(held, loops=True).rename_columns(["node", "root"])


def _stars(sides: DataFrame, own: bool) -> DataFrame:
    """From rows (`u`, `v`): every `v` (and `u` itself if `own`) tied to the least of u and its neighbours."""
    # Written, so that the join below is one of two plain shuffles and a node with many edges can be split.
    least = saved(sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
    ties = sides.join(least, F.col("u") == F.col("_u"))
    ties = ties.filter(F.col("v") > F.col("u")) if not own else ties
    out = ties.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        out = out.union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """`node` and `root` (least node of its component) of every node that has an edge to another one.

    Minima combine before each shuffle, and a node with many edges is split by the skew-join rule. The edge
    table never grows: every round ties nodes to smaller ones. Edges with null and loops are left out. At most
    `ONE_TASK_EDGES` edges meet in one task.
    """
    real = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    real = real.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    kind = real.schema["u"].dataType.simpleString()
    now, mark = saved(real.mapInArrow(_contracted, f"u {kind}, v {kind}"), "edges"), None
    for _ in range(MOST_ROUNDS):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen["n"] <= ONE_TASK_EDGES:
            return now.coalesce(1).mapInArrow(_finished, f"node {kind}, root {kind}")
        if mark == (seen["n"], seen["s"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        mark = (seen["n"], seen["s"])
        large = _stars(now.union(now.select("v", "u").toDF("u", "v")), own=False)
        now = saved(_stars(large.select("u", "v"), own=True), "edges")
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
