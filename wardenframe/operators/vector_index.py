"""Inverted-file index over vectors: cells by direction, every vector in the list of its cell, probes joined by cell.

Equal vectors are one entry of a list, so a vector with very many copies costs no more than any other. Cells are
fitted on a bounded sample; lists hold every vector. A search scans the lists of the nearest cells, and, if it is to be
exact, goes on with just those cells whose widest member could still beat the worst neighbour found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenframe.operators.retrieval import PRODUCT_BYTES, SIMILARITY_THRESHOLD, TILE_BYTES, KBest, comparable
from wardenframe.session import materialise

#: Vectors that cells are fitted on, per cell; most cells; rounds of the fit. Their product with the dimensions bounds the fit and what tasks are sent.
SAMPLE_PER_CELL, MOST_CELLS, FIT_ROUNDS = 64, 4096, 10
#: Slack of angles, in radians: more than the arc cosine of rounded products can be off.
ANGLE_SLACK = 1e-6
#: Cell of vectors without a direction (all zero).
NO_CELL = -1
#: Rows of probes that a task puts out at once.
PROBE_ROWS = 1 << 14


@dataclass(frozen=True)
class VectorIndex:
    """``lists``: (cell, rep, vector, angle) of every distinct vector; ``copies``: (chunk_id, rep); by cell its direction, entries and widest angle."""

    lists: DataFrame
    copies: DataFrame
    centroids: np.ndarray
    entries: dict[int, int]
    widest: np.ndarray


def _units(vectors: list) -> np.ndarray:
    m = np.array(vectors, float).reshape(len(vectors), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _slabs(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of so few that arrays of ``width`` numbers per row stay small."""
    rows = max(1, PRODUCT_BYTES // (8 * max(width, 1)))
    for pdf in frames:
        for low in range(0, len(pdf), rows):
            yield pdf.iloc[low: low + rows]


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def _with_representative(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors with ``rep``, their least key; every key with its ``rep``). Both come from aggregates and plain joins, so a frequent vector can be split."""
    rows = rows.where(F.col("vector").isNotNull() & F.col(key).isNotNull()).select(key, F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    name = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2")]
    named = rows.select(key, "vector", *name)
    distinct = materialise(named.groupBy("h1", "h2").agg(F.min(key).alias("rep"), F.first("vector").alias("vector")), "distinct-vectors")
    return distinct.select("rep", "vector"), named.select(key, "h1", "h2").join(distinct.select("rep", "h1", "h2"), ["h1", "h2"]).select(key, "rep")


def fit_cells(distinct: DataFrame, cells: int | None, seed: int) -> np.ndarray:
    """Directions of the cells: spherical k-means over about ``SAMPLE_PER_CELL`` vectors per cell, chosen by hash."""
    total = distinct.count()
    cells = max(2, min(MOST_CELLS, cells or round(math.sqrt(total))))
    share = min(1.0, cells * SAMPLE_PER_CELL / max(total, 1))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    sample = distinct.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 20)) < int(share * (1 << 20))).where(norm > 0)
    unit = sample.select(array_to_vector(F.transform("vector", lambda x: x / norm)).alias("features"))
    unit = materialise(unit, "index-sample")
    if unit.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=cells, seed=seed, maxIter=FIT_ROUNDS, distanceMeasure="cosine", initMode="random").fit(unit)
    return _units([c.tolist() for c in model.clusterCenters()])


def build_index(chunks: DataFrame, cells: int | None = None, seed: int = 1) -> VectorIndex:
    """Index of ``(chunk_id, vector)``. Null vectors are left out; all vectors have the same dimensions."""
    distinct, copies = _with_representative(chunks, "chunk_id")
    centroids = fit_cells(distinct, cells, seed)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slabs(frames, len(centroids)):
            units = _units(pdf["vector"].tolist())
            if len(centroids):
                angles = _angles(units, centroids)
                cell = angles.argmin(axis=1)
                angle = angles[np.arange(len(cell)), cell]
            else:
                cell, angle = np.zeros(len(units), int), np.zeros(len(units))
            none = ~units.any(axis=1)
            yield pd.DataFrame({"cell": np.where(none, NO_CELL, cell), "rep": pdf["rep"], "vector": pdf["vector"], "angle": np.where(none, 0.0, angle)})

    lists = materialise(distinct.mapInPandas(assign, "cell int, rep long, vector array<double>, angle double"), "index-lists")
    # One row per cell, and there are MOST_CELLS at most.
    known = lists.groupBy("cell").agg(F.count(F.lit(1)).alias("entries"), F.max("angle").alias("widest")).collect()
    widest = np.zeros(len(centroids))
    for r in known:
        if r["cell"] != NO_CELL:
            widest[r["cell"]] = r["widest"]
    return VectorIndex(lists, copies, centroids, {r["cell"]: r["entries"] for r in known}, widest)


_FOUND = "query_rep long, rep long, similarity double"


def _rows_per_block(index: VectorIndex, tile_bytes: int) -> int:
    return max(1, tile_bytes // (8 * max(index.centroids.shape[1] if len(index.centroids) else 1, 1)))


def _cell_groups(index: VectorIndex, rows: int) -> dict[int, int]:
    """Group of each cell: neighbours by number share one up to ``rows`` entries, a larger cell has its own."""
    groups, group, held = {}, -1, rows
    for cell in sorted(index.entries):
        if held + index.entries[cell] > rows:
            group, held = group + 1, 0
        groups[cell] = group
        held += index.entries[cell]
    return groups


def _probes(pdf: pd.DataFrame, row: np.ndarray, cell: np.ndarray, groups: dict[int, int]) -> Iterator[pd.DataFrame]:
    """One row per query and group of cells, with the cells that it asks for there; ``row`` and ``cell`` are the pairs."""
    known = sorted(groups)
    group = np.array([groups[c] for c in known], int)[np.searchsorted(known, cell)]
    order = np.lexsort((cell, group, row))
    row, cell, group = row[order], cell[order], group[order]
    begin = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(group) != 0)]) if len(row) else np.zeros(0, int)
    end = np.r_[begin[1:], len(row)].astype(int)
    for low in range(0, len(begin), PROBE_ROWS):
        b, e = begin[low: low + PROBE_ROWS], end[low: low + PROBE_ROWS]
        yield pd.DataFrame({
            "query_rep": pdf["query_rep"].to_numpy()[row[b]], "vector": pdf["vector"].iloc[row[b]].to_numpy(),
            "cell_group": group[b].astype("int32"), "cells": [cell[x:y].astype("int32") for x, y in zip(b, e)],
        })


def _scan(index: VectorIndex, probes: DataFrame, k: int, threshold: float, tile_bytes: int) -> DataFrame:
    """The k best entries of the probed lists per query and block; probes are (query_rep, vector, cell_group, cells).

    A query travels once to each group of cells it probes, however many of its cells these are.
    """
    rows = _rows_per_block(index, tile_bytes)
    spark = probes.sparkSession
    groups = _cell_groups(index, rows)
    entries: dict[int, int] = {}
    for c, g in groups.items():
        entries[g] = entries.get(g, 0) + index.entries[c]
    # Lists and probes of a group are cut into blocks, which meet pairwise; one row per group, or per cell.
    asked = probes.groupBy("cell_group").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("query_blocks"))
    held = spark.createDataFrame([(g, -(-n // rows)) for g, n in entries.items()], "cell_group int, blocks int")
    sizes = F.broadcast(held.join(asked, "cell_group"))
    group_of = F.broadcast(spark.createDataFrame(list(groups.items()), "cell int, cell_group int"))

    def spread(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = probes.join(sizes, "cell_group").select("cell_group", "query_rep", "vector", "cells", F.pmod(F.xxhash64("query_rep"), "query_blocks").cast("int").alias("query_block"), spread("blocks").alias("block"))
    right = index.lists.join(group_of, "cell").join(sizes, "cell_group").select("cell_group", "cell", "rep", "vector", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), spread("query_blocks").alias("query_block"))

    def group(asking: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        best = KBest(len(asking), k, threshold)
        queries = asking["query_rep"].to_numpy() if len(asking) else np.zeros(0, int)
        if len(asking) and len(listed):
            units = _units(asking["vector"].tolist())
            counts = asking["cells"].map(len).to_numpy()
            row, wanted = np.repeat(np.arange(len(asking)), counts), np.concatenate(asking["cells"].tolist())
            order = np.argsort(wanted, kind="stable")
            row, wanted = row[order], wanted[order]
            for cell, entries in listed.groupby("cell"):
                at = row[np.searchsorted(wanted, cell, "left"): np.searchsorted(wanted, cell, "right")]
                if len(at):
                    ids, vectors = comparable(entries, "rep")
                    best.compare(units[at], at, vectors, ids)
        at, rep, sim = best.found()
        return pd.DataFrame({"query_rep": queries[at], "rep": rep, "similarity": sim}).astype({"query_rep": "int64", "rep": "int64", "similarity": "float64"})

    keys = ["cell_group", "block", "query_block"]
    return _best(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(group, _FOUND), "query_rep", "rep", k)


def _best(found: DataFrame, query: str, entry: str, k: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), entry)
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def search_index(index: VectorIndex, queries: DataFrame, k: int, threshold: float = SIMILARITY_THRESHOLD, probes: int = 8, exact: bool = True, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Nearest chunks ``(query_id, chunk_id, similarity)`` of ``(query_id, vector)``, best first, smaller id first on ties.

    ``probes`` cells are scanned for each distinct query. With ``exact`` the search goes on where the angle between
    query and cell, less the cell's widest angle, leaves room for a better neighbour; the result is that of comparing all
    pairs. Without it, neighbours in cells further off are missed. A chunk travels to the blocks of its own cell
    only, a query to those of the cells it probes.
    """
    distinct, asked_by = _with_representative(queries, "query_id")
    centroids, widest, filled = index.centroids, index.widest, np.array(sorted(c for c in index.entries if c != NO_CELL), int)
    aimless = NO_CELL in index.entries
    groups = _cell_groups(index, _rows_per_block(index, tile_bytes))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slabs(frames, len(filled)):
            units = _units(pdf["vector"].tolist())
            cells = np.zeros((len(units), 0), int)
            if len(filled):
                angles = _angles(units, centroids[filled])
                cells = filled[np.argsort(angles, axis=1, kind="stable")[:, :probes]]
            if aimless:
                cells = np.column_stack([cells, np.full(len(units), NO_CELL)])
            count = cells.shape[1]
            yield from _probes(pdf, np.repeat(np.arange(len(pdf)), count), cells.ravel(), groups)

    asking = distinct.withColumnRenamed("rep", "query_rep")
    probe_schema = "query_rep long, vector array<double>, cell_group int, cells array<int>"
    first = materialise(asking.mapInPandas(nearest, probe_schema), "index-probes")
    found = materialise(_scan(index, first, k, threshold, tile_bytes), "index-found")
    if exact and len(filled):
        def further(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in _slabs(frames, len(filled)):
                units = _units(pdf["vector"].tolist())
                angles = _angles(units, centroids[filled])
                seen = np.argsort(angles, axis=1, kind="stable")[:, :probes]
                least = np.cos(np.maximum(angles - widest[filled] - ANGLE_SLACK, 0.0))
                least[~units.any(axis=1)] = 1.0  # a query without a direction is equally far from all
                open_ = least >= pdf["bound"].to_numpy()[:, None] - ANGLE_SLACK
                np.put_along_axis(open_, seen, False, axis=1)
                row, at = np.nonzero(open_)
                yield from _probes(pdf, row, filled[at], groups)

        worst = found.groupBy("query_rep").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
        bounded = asking.join(worst, "query_rep", "left").select("query_rep", "vector", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float(threshold))).alias("bound"))
        more = materialise(bounded.mapInPandas(further, probe_schema), "index-probes")
        found = _best(found.unionByName(_scan(index, more, k, threshold, tile_bytes)), "query_rep", "rep", k)
    # Of the copies of an entry the k least keys are enough; the rank limit applies before the shuffle.
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("chunk_id"))
    members = index.copies.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
    near = _best(found.join(members, "rep"), "query_rep", "chunk_id", k)
    return near.join(asked_by.withColumnRenamed("rep", "query_rep"), "query_rep").select("query_id", "chunk_id", "similarity")


def tuned_probes(index: VectorIndex, queries: DataFrame, k: int, threshold: float = SIMILARITY_THRESHOLD, target: float = 0.95, sample: int = 256, seed: int = 1) -> int:
    """Least number of probes with which about ``sample`` queries, chosen by hash, find the share ``target`` of their exact neighbours.

    Their exact search tells how far down a query's order of cells each neighbour lies.
    """
    total = max(queries.count(), 1)
    some = queries.where(F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(1 << 20)) < int(min(1.0, sample / total) * (1 << 20)))
    near = search_index(index, some, k, threshold).join(some, "query_id")
    cells = index.lists.select("rep", "cell").join(index.copies, "rep").select("chunk_id", "cell")
    centroids, filled = index.centroids, np.array(sorted(c for c in index.entries if c != NO_CELL), int)

    def depth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slabs(frames, len(filled)):
            order = np.argsort(_angles(_units(pdf["vector"].tolist()), centroids[filled]), axis=1, kind="stable")
            yield pd.DataFrame({"depth": 1 + (filled[order] == pdf["cell"].to_numpy()[:, None]).argmax(axis=1)})

    if not len(filled):
        return 1
    depths = near.join(cells.where(F.col("cell") != NO_CELL), "chunk_id").select("vector", "cell").mapInPandas(depth, "depth int")
    # At most one row per cell.
    counts = sorted((r["depth"], r["count"]) for r in depths.groupBy("depth").count().collect())
    reached, wanted = 0, target * sum(n for _, n in counts)
    for at, n in counts:
        reached += n
        if reached >= wanted:
            return at
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries with a neighbour, their exact pairs, how many of these were found, and that share."""
    pairs = ["query_id", "chunk_id"]
    hit = exact.select(*pairs).join(found.select(*pairs).withColumn("_hit", F.lit(1)), pairs, "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"), F.count("_hit").alias("found")).withColumn("recall", F.coalesce(F.try_divide(F.col("found").cast("double"), "pairs"), F.lit(1.0)))
