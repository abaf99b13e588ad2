"""Isolation forest as a Spark job: bounded samples per tree, one task per tree, scoring by batches.

The sample of a tree is chosen by hash, so a lost executor rebuilds the same tree. The forest is a
table of at most ``trees * 2 * sample`` nodes, whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenframe.functions.columns import tiers, with_scalars
from wardenframe.functions.quantiles import quantile_row
from wardenframe.session import materialise

#: Rows that a scoring task gets.
ROWS_PER_TASK = 50_000
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
# Tree count and share of anomalies of the four model set-ups (None: automatic cut at 0.5).
SETUPS = {
    "claims_quick": (200, None),
    "claims_full": (500, 0.05),
    "authorization": (300, 0.05),
    "prescriber": (200, 0.01),
}
RISK_BANDS = ((0.75, "CRITICAL"), (0.55, "HIGH"), (0.40, "MEDIUM"))


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    trees: int
    sample: int
    nodes: tuple[tuple, ...]


def _least(keyed: DataFrame, order: Sequence[str], wanted: int) -> DataFrame:
    """The ``wanted`` rows with the least hash ``_h``. Rows above a hash that surely leaves enough go first, so that few more than wanted meet in one task."""
    rows = keyed.count()
    share = 1.2 * wanted / max(rows, 1) + 0.001
    if share < 1:
        near = keyed.where(F.col("_h") < F.lit(int(share * 2**64) - 2**63))
        if near.count() >= wanted:
            keyed = near
    return keyed.orderBy(*order).limit(wanted)


def tree_samples(df: DataFrame, keys: Sequence[str], features: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` rows per tree without repetition inside a tree (all rows, where there are fewer).

    The pool holds the ``trees * sample`` rows with the smallest hash, numbered in that order; every tree
    draws its numbers by its own seed. Pool and numbers are bounded by the parameters, whatever the table.
    """
    order = ["_h", *[f"_k{i}" for i in range(len(keys))]]
    keyed = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.xxhash64(F.lit(seed), *keys).alias("_h"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    pool = materialise(_least(keyed, order, trees * sample), "forest-pool")
    size = pool.count()
    numbered = pool.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1)
    drawn = [np.random.default_rng([seed, t]).choice(size, min(sample, size), replace=False) for t in range(trees)]
    draws = pd.DataFrame({"tree": np.repeat(np.arange(trees, dtype=np.int32), [len(d) for d in drawn]), "_n": np.concatenate(drawn).astype(np.int32)})
    return numbered.join(df.sparkSession.createDataFrame(draws), "_n").select("tree", *features)


def _grow(values: np.ndarray, tree: int, limit: int, seed: int) -> pd.DataFrame:
    """Random splits down to single points, equal points or the depth limit; one row per node."""
    rng = np.random.default_rng([seed, tree])
    rows: list[list] = []
    pending = [(np.arange(len(values)), 0, -1, False)]
    while pending:
        members, depth, parent, is_right = pending.pop()
        node = len(rows)
        if parent >= 0:
            rows[parent][5 if is_right else 4] = node
        part = values[members]
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        row = [tree, node, -1, 0.0, -1, -1, len(members), depth]
        rows.append(row)
        if depth < limit and len(members) > 1 and len(splittable):
            f = int(rng.choice(splittable))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = part[:, f] <= cut
            if goes_left.all() or not goes_left.any():
                goes_left = part[:, f] < high[f]
                cut = float(part[goes_left, f].max())
            row[2], row[3] = f, cut
            pending.append((members[~goes_left], depth + 1, node, True))
            pending.append((members[goes_left], depth + 1, node, False))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def fit_forest(df: DataFrame, keys: Sequence[str], features: Sequence[str], trees: int = 200, sample: int = 256, seed: int = 42) -> Forest:
    """Grow the trees in parallel; features must be filled (impute first)."""
    features = tuple(features)
    samples = tree_samples(df, keys, features, trees, sample, seed)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[list(features)].to_numpy(dtype=float)
        order = np.lexsort(values.T[::-1])  # rows arrive in any order
        limit = math.ceil(math.log2(max(len(values), 2)))
        return _grow(values[order], int(pdf["tree"].iloc[0]), limit, seed)

    nodes = samples.groupBy("tree").applyInPandas(build, NODE_SCHEMA)
    rows = tuple(tuple(r) for r in nodes.orderBy("tree", "node").collect())
    per_tree = max((r[6] for r in rows), default=1)
    return Forest(features, trees, per_tree, rows)


def _levelled(rows: Sequence[tuple], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree with all leaves at ``depth``: feature and threshold of inner nodes (children of n are 2n + 1 and 2n + 2) and path lengths of the leaves.

    Below a leaf that is higher up, both children stand for it. The depth is bounded by the sample of a tree.
    """
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros(inner, np.intp), np.zeros(inner), np.zeros(inner + 1)
    pending = [(0, 0)]
    while pending:
        at, node = pending.pop()
        _, _, f, cut, left, right, size, level = rows[node]
        if at >= inner:
            leaf[at - inner] = level + expected_path(size)
            continue
        feature[at], threshold[at] = max(f, 0), cut
        pending += [(2 * at + 1, left), (2 * at + 2, right)] if f >= 0 else [(2 * at + 1, node), (2 * at + 2, node)]
    return feature, threshold, leaf


def _paths(x: np.ndarray, trees: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """Path length of each row, summed over the trees. All rows go down a level together."""
    flat, starts = np.ascontiguousarray(x).ravel(), np.arange(len(x), dtype=np.intp) * x.shape[1]
    path = np.zeros(len(x))
    for feature, threshold, leaf in trees:
        at = np.zeros(len(x), np.intp)
        for _ in range(depth):
            goes_left = flat.take(feature.take(at) + starts) <= threshold.take(at)
            at += at
            at += 2
            at -= goes_left
        path += leaf.take(at - len(feature))
    return path


def score(df: DataFrame, forest: Forest, keep: Sequence[str], name: str = "isolation_score") -> DataFrame:
    """2^(-mean path / expected path) per row; close to 1 is isolated, about 0.5 is ordinary."""
    trees: dict[int, list] = {}
    for r in forest.nodes:
        trees.setdefault(r[0], []).append(r)
    depth = max((r[7] for r in forest.nodes), default=0)
    shared = df.sparkSession.sparkContext.broadcast([_levelled(rows, depth) for rows in trees.values()])
    columns, normal = list(forest.features), expected_path(forest.sample) or 1.0
    keep = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            path = _paths(pdf[columns].to_numpy(dtype=float), shared.value, depth)
            out[name] = np.exp2(-(path / max(len(shared.value), 1)) / normal)
            yield out

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", {name} double"
    extra = [c for c in columns if c not in keep]
    narrow = df.select(*keep, *extra)
    # Walking hundreds of trees costs far more than moving a narrow row, so rows are dealt to all cores first.
    cores = narrow.sparkSession.sparkContext.defaultParallelism
    return narrow.repartition(max(cores, -(-narrow.count() // ROWS_PER_TASK)), *keep).mapInPandas(run, schema)


def detect(df: DataFrame, keys: Sequence[str], features: Sequence[str], trees: int = 200, contamination: float | None = None, sample: int = 256, seed: int = 42) -> DataFrame:
    """Keys with anomaly score (higher is worse), flag, severity and a score scaled to 0..1.

    The raw scores are written once, because three passes read them and scoring runs in Python.
    """
    forest = fit_forest(df, keys, features, trees, sample, seed)
    raw = materialise(score(df, forest, keys), "forest-scores")
    probs = {"medium": 0.90, "high": 0.95}
    if contamination is not None:
        probs["cut"] = 1 - contamination
    limits = quantile_row(raw, ["isolation_score"], probs)
    wide = with_scalars(with_scalars(raw, limits, "_q"), raw.agg(F.min("isolation_score").alias("low"), F.max("isolation_score").alias("high")), "_r")
    cut = F.lit(0.5) if contamination is None else F.col("_q.isolation_score__cut")
    value = F.col("isolation_score")
    spread = F.col("_r.high") - F.col("_r.low")
    return wide.select(
        *keys,
        (value - cut).alias("anomaly_score"),
        (value > cut).alias("is_anomaly"),
        F.when(value > cut, -1).otherwise(1).alias("prediction"),
        F.when(value >= F.col("_q.isolation_score__high"), "HIGH").when(value >= F.col("_q.isolation_score__medium"), "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(spread > 0, (value - F.col("_r.low")) / spread).otherwise(0.0).alias("normalised_score"),
    )


def risk_score(anomaly_score: Column) -> Column:
    """The service's risk: half a point above the signed score, clipped to 0..1."""
    return F.least(F.greatest(anomaly_score + 0.5, F.lit(0.0)), F.lit(1.0))


def risk_band(risk: Column) -> Column:
    return tiers(risk, RISK_BANDS, "LOW")


def contributing_features(scaled: dict[str, Column], values: dict[str, Column], limit: float = 1.0, top: int = 5) -> Column:
    """Features at least one scale unit off, farthest first, at most ``top`` (a top-k report)."""
    items = []
    for i, (name, s) in enumerate(scaled.items()):
        off = F.round(F.abs(s), 3)
        items.append(F.when(F.coalesce(F.abs(s) >= limit, F.lit(False)), F.struct(
            (-off).alias("order"), F.lit(i).alias("place"), F.lit(name).alias("feature"), F.round(values[name], 4).alias("value"),
            F.when(s > 0, "above_normal").otherwise("below_normal").alias("direction"), off.alias("deviation_score"),
        )))
    return F.slice(F.sort_array(F.array_compact(F.array(*items))), 1, top)
