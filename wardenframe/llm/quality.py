"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every text become `FEATURES` cosines whose inner products approximate a Gaussian kernel.
Each partition sums the normal equations of its labelled rows, per fold; the sums have the size of the
features, so the driver solves them whatever the number of rows. Each fold is scored by the equations of
the other folds, and these honest scores, counted in bins, give the monotone map to probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import WHITE, byte_table, saved, sum_per_row, table, text_remainder, text_steps

#: Number of cosines, ridge weight per row, folds, bins of the calibration, seed of the random directions.
FEATURES, RIDGE, FOLDS, BINS, SEED = 192, 1e-4, 3, 2000, 7
STATISTICS = (
    "log_words", "mean_word", "long_word", "upper", "digit", "stop", "symbol", "other_byte", "line", "distinct_words", "distinct_lines", "packed", "bare_words", "loud_words",
)
#: Bytes of a text that are packed at once to measure repetition.
PACK_BYTES = 1 << 16

_KINDS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:?'\"()-", "symbol": "#*$%&|<>!@^~_=+{}[]/\\"}


def text_statistics(texts: pa.Array) -> np.ndarray:
    """One row of `STATISTICS` per text; all zero for null and empty ones."""
    out = np.zeros((len(texts), len(STATISTICS)))
    white, kinds = byte_table(WHITE), {n: byte_table(m) for n, m in _KINDS.items()}
    letter = byte_table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)
    for first, last, data, offsets in text_steps(texts):
        gap = white[data]
        begins = np.ones(len(data), bool)
        begins[1:] = gap[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins &= ~gap
        inside = np.maximum(sum_per_row((~gap).astype(np.int64), offsets), 1)
        words = sum_per_row(begins.astype(np.int64), offsets)
        block = out[first:last]
        block[:, 0] = np.log1p(words)
        block[:, 1] = inside / np.maximum(words, 1) * (words > 0)
        for name, members in kinds.items():
            block[:, STATISTICS.index(name)] = sum_per_row(members[data].astype(np.int64), offsets) / inside
        block[:, STATISTICS.index("other_byte")] = sum_per_row((data >= 128).astype(np.int64), offsets) / inside
        block[:, STATISTICS.index("line")] = sum_per_row((data == 10).astype(np.int64), offsets) / np.maximum(words, 1)
        bare = begins & ~letter[data]
        loud = begins & kinds["upper"][data]
        loud[:-1] &= kinds["upper"][data[1:]]
        block[:, STATISTICS.index("bare_words")] = sum_per_row(bare.astype(np.int64), offsets) / np.maximum(words, 1)
        block[:, STATISTICS.index("loud_words")] = sum_per_row(loud.astype(np.int64), offsets) / np.maximum(words, 1)
        raw = data.tobytes()
        for row in range(last - first):
            one = raw[offsets[row]: offsets[row + 1]]
            parts, lines = one.split(), [x for x in one.split(b"\n") if x.strip()]
            if parts:
                block[row, STATISTICS.index("long_word")] = np.log1p(max(map(len, parts)))
                block[row, STATISTICS.index("distinct_words")] = len(set(parts)) / len(parts)
                block[row, STATISTICS.index("distinct_lines")] = len(set(lines)) / len(lines)
                packed = sum(len(zlib.compress(one[a: a + PACK_BYTES], 1)) for a in range(0, len(one), PACK_BYTES))
                block[row, STATISTICS.index("packed")] = packed / len(one)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = text_statistics(batch.column("text"))
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(list(found), pa.list_(pa.float64()))], names=[*kept, "x"])


def statistics_table(df: DataFrame, key: str, text: str, carry: str) -> DataFrame:
    """`id`, the carried column and the statistics `x` of every row; the texts are read once."""
    rows = df.select(F.col(key).alias("id"), F.col(carry).alias("carried"), F.col(text).alias("text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "carried"))
    return saved(rows.mapInArrow(_statistics, f"{kinds}, x array<double>"), "statistics")


@dataclass(frozen=True)
class QualityModel:
    """Scaling of the statistics, random directions, ridge weights, and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.features(x) @ (self.weights if weights is None else weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.values)


def isotonic(points: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and nondecreasing shares of positives that fit best; neighbours that violate the order are pooled."""
    pools: list[list[float]] = []
    for point, positive, count in zip(points, positives, counts):
        if count:
            pools.append([point, point, positive, count])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                _, right, p, n = pools.pop()
                pools[-1] = [pools[-1][0], right, pools[-1][2] + p, pools[-1][3] + n]
    edges = [(e, (p + 0.5) / (n + 1)) for a, b, p, n in pools for e in ((a, b) if b > a else (a,))]
    return np.array([e for e, _ in edges]), np.maximum.accumulate([v for _, v in edges])


def _equations(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.phases) + len(STATISTICS) + 1
        gram = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            z, y, fold = model.features(x), np.array(batch.column("label"), float), np.array(batch.column("fold"))
            for k in range(FOLDS):
                mine = z[fold == k]
                gram[k] += mine.T @ np.hstack([mine, y[fold == k][:, None]])
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int32()), pa.array(np.arange(size, dtype=np.int32)), pa.array(list(gram[k]), pa.list_(pa.float64()))], names=["fold", "line", "sums"])
    return run


def _solve(gram: np.ndarray) -> np.ndarray:
    size = gram.shape[0]
    rows = max(gram[-1, size - 1], 1.0)  # the last feature is 1
    return np.linalg.solve(gram[:, :size] + RIDGE * rows * np.eye(size), gram[:, size])


def fit(labelled: DataFrame) -> QualityModel:
    """Model of rows with `x` (statistics), `label` (0 or 1) and `fold`. Without rows every score is 0.5."""
    count = len(STATISTICS)
    moments = labelled.agg(
        F.count("*").alias("n"), *[F.avg(F.get("x", k)).alias(f"m{k}") for k in range(count)], *[F.stddev_pop(F.get("x", k)).alias(f"s{k}") for k in range(count)],
    ).first()
    rng = np.random.default_rng(SEED)
    directions, phases = rng.normal(size=(count, FEATURES)) / np.sqrt(count), rng.uniform(0, 2 * np.pi, FEATURES)
    if not moments["n"]:
        return QualityModel(np.zeros(count), np.ones(count), directions, phases, np.zeros(FEATURES + count + 1), np.zeros(1), np.full(1, 0.5))
    mean = np.array([moments[f"m{k}"] for k in range(count)])
    scale = np.array([max(moments[f"s{k}"], 1e-6) for k in range(count)])
    empty = np.zeros(FEATURES + count + 1)
    base = QualityModel(mean, scale, directions, phases, empty, np.zeros(1), np.zeros(1))
    sums = labelled.mapInArrow(_equations(base), "fold int, line int, sums array<double>").select("fold", "line", F.posexplode("sums").alias("at", "v"))
    lines = sums.groupBy("fold", "line", "at").agg(F.sum("v").alias("v")).groupBy("fold", "line").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v"))
    gram = np.zeros((FOLDS, len(empty), len(empty) + 1))
    # FOLDS x features rows, whatever the input.
    for row in lines.select("fold", "line", F.transform("v", lambda e: e["v"]).alias("v")).toLocalIterator():
        gram[row["fold"], row["line"]] = row["v"]
    whole = gram.sum(axis=0)
    others = np.stack([_solve(whole - gram[k]) for k in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, count)
            raw = np.einsum("ij,ij->i", base.features(x), others[np.array(batch.column("fold"))])
            bins = np.clip(np.round((raw + 0.5) * BINS / 2), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label")], names=["bin", "label"])

    tallies = labelled.select("x", "fold", F.col("label").cast("int").alias("label")).mapInArrow(binned, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("p"), F.count("*").alias("n")).orderBy("bin").collect()
    points = np.array([t["bin"] for t in tallies]) * 2 / BINS - 0.5
    steps, values = isotonic(points, np.array([t["p"] for t in tallies], float), np.array([t["n"] for t in tallies], float))
    return QualityModel(mean, scale, directions, phases, _solve(whole), steps, values)


def quality_scores(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn: str | None = None, carry: str | None = None) -> DataFrame:
    """Key (or the column `carry` instead) and `score` (0 to 1; share of good texts among labelled ones that look alike) of every row.

    `labels` gives 0 or 1 per key; rows that do not meet the SQL condition `learn` on the key are not learned from, nor
    null labels. A key with several rows or labels counts for each pair. Null and empty texts are scored
    as texts without words; repeated rows score alike; without any label to learn from every score is 0.5;
    an empty table gives no rows. Other columns are not read.
    """
    statistics = statistics_table(df, key, text, carry or key)
    wanted = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    wanted = wanted.filter(learn) if learn else wanted
    wanted = wanted.select(F.col(key).alias("id"), F.col(label).cast("double").alias("label"))
    fold = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(FOLDS)).cast("int")
    labelled = saved(statistics.join(wanted, "id").select("x", "label", fold.alias("fold")), "labelled")
    shared = df.sparkSession.sparkContext.broadcast(fit(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(shared.value.score(x))], names=["carried", "score"])

    return statistics.select("carried", "x").mapInArrow(run, f"carried {statistics.schema['carried'].dataType.simpleString()}, score double").withColumnRenamed("carried", carry or key)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = text_remainder("doc_id", 3) == 1
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn="crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 <> 1")
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
