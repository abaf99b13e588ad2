"""Language identification as inference of a mixture.

Every language has a distribution over hashed letter trigrams. A text is a mixture of languages; its
proportions come from expectation-maximisation on the trigram likelihoods. Sets of languages, taken in
order of their proportions, compete by likelihood less a price per language, and the winning set's
proportions are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import mix64, saved, table, text_remainder, text_steps

#: Bins of hashed trigrams, rows worked on together, and rounds of expectation-maximisation that order the languages.
BINS, ROWS, ROUNDS = 4096, 256, 12
#: Proportions are settled when no round moves one by more.
STILL, MOST_ROUNDS = 1e-4, 500
#: Added to every count of a language, and the price of a further language in units of log(trigrams)/2.
SMOOTHING, PRICE = 0.5, 6.0
UNKNOWN = "und"


def _folded() -> np.ndarray:
    """Bytes to symbols: ASCII letters without case, bytes of other scripts as they are, all else one gap."""
    to = np.zeros(256, np.uint64)
    for k in range(26):
        to[65 + k] = to[97 + k] = 1 + k
    to[128:] = np.arange(128, 256)
    return to


def _trigram_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, counts by bin) for runs of rows. Only trigrams around a letter count."""
    folded = _folded()
    for first, last, data, offsets in text_steps(texts):
        for low in range(first, last, ROWS):
            high = min(low + ROWS, last)
            a, b = offsets[low - first], offsets[high - first]
            s = folded[data[a:b]]
            counts = np.zeros((high - low, BINS), np.float32)
            if len(s):
                row = np.repeat(np.arange(high - low), np.diff(offsets[low - first: high - first + 1]))
                # A text begins and ends with a gap.
                before, after = np.zeros_like(s), np.zeros_like(s)
                same = row[1:] == row[:-1]
                before[1:], after[:-1] = s[:-1] * same, s[1:] * same
                lettered = s > 0
                gram = (before << np.uint64(16)) | (s << np.uint64(8)) | after
                bins = (mix64(gram[lettered]) % np.uint64(BINS)).astype(np.int64)
                counts = np.bincount(row[lettered] * BINS + bins, minlength=(high - low) * BINS).reshape(high - low, BINS).astype(np.float32)
            yield low, high, counts


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of a task's rows."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, last, counts in _trigram_counts(batch.column("text")):
            for lang in set(langs[first:last]):
                sums[lang] = sums.get(lang, 0) + counts[langs[first:last] == lang].sum(axis=0, dtype=np.float64)
    for lang, counts in sums.items():
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(counts[full].astype(np.int64))], names=["lang", "bin", "n"])


def learn_languages(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their trigram probabilities (languages x bins). Null languages are not learned."""
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(_tally, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # One number per language and bin, whatever the number of rows.
    found = counts.groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    names = [r["lang"] for r in found]
    table_ = np.full((len(names), BINS), SMOOTHING)
    for k, r in enumerate(found):
        table_[k, r["bins"]] += r["n"]
    return names, table_ / table_.sum(axis=1, keepdims=True)


def mixtures(counts: np.ndarray, likelihood: np.ndarray, rounds: int = ROUNDS, price: float = PRICE) -> np.ndarray:
    """Proportions (rows x languages) of the set of languages with the best penalised likelihood; 0 outside the set.

    Sets grow along the order of the proportions in the mixture of all languages, as long as any larger set can win: no
    mixture has a higher likelihood than the bound that the languages' multipliers in expectation-maximisation give.
    """
    rows, languages = len(counts), len(likelihood)
    likelihood = likelihood.astype(np.float32)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1).astype(np.float32)

    def multipliers(weights: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        return ((counts[at] / np.maximum(weights @ likelihood, 1e-30)) @ likelihood.T) / total[at]

    def settle(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rounds until every row stands still."""
        moving = np.arange(len(weights))
        for _ in range(MOST_ROUNDS):
            old = weights[moving]
            new = old * multipliers(old, at[moving])
            new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-30)
            weights[moving] = new
            moving = moving[np.abs(new - old).max(axis=1) > STILL]
            if not len(moving):
                break
        return weights

    def gain(weights: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        return np.einsum("ij,ij->i", counts[at], np.log(np.maximum(weights @ likelihood, 1e-30)))

    every = slice(None)
    weights = np.full((rows, languages), 1 / languages, np.float32)
    for _ in range(rounds):
        weights *= multipliers(weights, every)
        weights /= np.maximum(weights.sum(axis=1, keepdims=True), 1e-30)
    order = np.argsort(-weights, axis=1, kind="stable")
    # The likelihood is concave in the proportions: it exceeds its value here by total * (greatest multiplier - 1) at most.
    most = gain(weights, every) + total[:, 0] * np.maximum(multipliers(weights, every).max(axis=1) - 1, 0)
    # Among sets of one language the likelihood alone decides.
    single = counts @ np.log(likelihood).T
    best = np.zeros_like(weights)
    best[np.arange(rows), single.argmax(axis=1)] = 1
    unit = price * np.log(total[:, 0] + 1) / 2
    value = single.max(axis=1) - unit
    for size in range(2, languages + 1):
        open_ = np.flatnonzero(most - size * unit > value)
        if not len(open_):
            break
        chosen = np.zeros((len(open_), languages), np.float32)
        np.put_along_axis(chosen, order[open_, :size], np.take_along_axis(weights[open_], order[open_, :size], axis=1) + 1e-6, axis=1)
        part = settle(chosen / chosen.sum(axis=1, keepdims=True), open_)
        found = gain(part, open_) - size * unit[open_]
        better = found > value[open_]
        value[open_[better]] = found[better]
        best[open_[better]] = part[better]
    return best


def _any_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict_languages(df: DataFrame, names: list[str], likelihood: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `lang_pred`, `score` (proportion of that language) and `shares` (language to proportion) of every row.

    Null texts and those without a letter are `und` with score 0, as are all when nothing was learned.
    Of equally likely languages the first by name is taken. Repeated rows are predicted alike; an empty table gives no rows; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast((names, likelihood))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, likelihood = shared.value
        for batch in batches:
            texts = batch.column("text")
            lettered = np.array([_any_letter(t.as_py()) for t in texts], bool)
            shares = np.zeros((batch.num_rows, len(names)))
            if names:
                for first, last, counts in _trigram_counts(texts):
                    shares[first:last] = mixtures(counts, likelihood)
            shares[~lettered] = 0
            top = shares.argmax(axis=1) if names else np.zeros(batch.num_rows, int)
            score = np.clip(shares.max(axis=1, initial=0), 0, 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array([names[k] if s > 0 else UNKNOWN for k, s in zip(top, score)], pa.string()), pa.array(score, pa.float64()),
                pa.array([[(names[k], float(v)) for k, v in enumerate(row) if v > 0] for row in shares], pa.map_(pa.string(), pa.float64())),
            ], names=["key", "lang_pred", "score", "shares"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, shares map<string,double>").withColumnRenamed("key", key)


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = text_remainder("doc_id", 4) == 2
    names, likelihood = learn_languages(docs.filter(~held_out))
    out = predict_languages(docs, names, likelihood)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
