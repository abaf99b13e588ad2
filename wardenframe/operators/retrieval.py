"""Knowledge retrieval: chunking, exact cosine top-k, hybrid ranking and source-diverse selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 800, 120
TOP_K, SIMILARITY_THRESHOLD = 5, 0.35
SEMANTIC_WEIGHT, EVIDENCE_WEIGHT = 0.70, 0.30
MIN_KNOWLEDGE_SCORE, MAX_SUPPORTING_KNOWLEDGE = 0.35, 5
# The white space that is trimmed from text.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
#: Vectors of a block, vectors of one side that a task is sent at once, and products that it holds at once, in bytes.
TILE_BYTES, GROUP_BYTES, PRODUCT_BYTES = 4 * 1024 * 1024, 4 * 1024 * 1024, 8 * 1024 * 1024


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))


def chunk_documents(docs: DataFrame, text: str, keep: Sequence[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed-width overlapping chunks of the whole trimmed text; empty chunks are left out before numbering."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    body = docs.select(*keep, strip(F.col(text)).alias("_t")).where(F.length("_t") > 0)
    last = F.greatest(F.ceil((F.length("_t") - size) / step), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(F.col("_t"), i * step + 1, F.lit(size))))
    return body.select(*keep, F.posexplode(F.filter(cut, lambda c: c != "")).alias("chunk_id", "text"))


# ---------------------------------------------------------------- cosine top-k


def _unit(vectors: Sequence[np.ndarray]) -> np.ndarray:
    m = np.vstack(vectors).astype(float)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


class KBest:
    """Of every row the k greatest similarities at or above the threshold, smaller id first on ties, gathered block by block."""

    def __init__(self, rows: int, k: int, threshold: float):
        self.k, self.bound = k, np.full(rows, float(threshold))
        self.room = 2 * k * rows + (1 << 16)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def compare(self, left: np.ndarray, at: np.ndarray, right: np.ndarray, ids: np.ndarray) -> None:
        """Compares unit vectors of the rows ``at`` with those of ``ids``; few of the products are held at once."""
        step = max(1, PRODUCT_BYTES // (8 * max(len(ids), 1)))
        for low in range(0, len(at), step):
            sim, rows = left[low: low + step] @ right.T, at[low: low + step]
            hit = sim >= self.bound[rows, None]
            n = int(np.count_nonzero(hit))
            if n > 2 * self.k * len(rows) and len(ids) > self.k:
                # Nothing below the k-th best of a block can stay.
                kth = np.partition(sim, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                hit &= sim >= kth[:, None]
                n = int(np.count_nonzero(hit))
            if n:
                r, c = np.nonzero(hit)
                self.parts.append((rows[r], ids[c], sim[r, c]))
                self.held += n
                if self.held > self.room:
                    self._shorten()

    def _shorten(self) -> None:
        row, key, sim = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((key, -sim, row))
        row, key, sim = row[order], key[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == self.k - 1
        self.bound[row[full]] = sim[full]
        kept = place < self.k
        self.parts = [(row[kept], key[kept], sim[kept])]
        self.held = int(kept.sum())

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, similarity), best first within a row."""
        if not self.parts:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        self._shorten()
        return self.parts[0]


def comparable(frame: pd.DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, unit vectors) of the rows; those with a component that is no number are like nothing."""
    if frame.empty:
        return np.zeros(0, int), np.zeros((0, 0))
    units = _unit(frame["vector"].tolist())
    plain = ~np.isnan(units).any(axis=1)
    return frame[key].to_numpy()[plain], units[plain]


_PAIR = "query_id long, chunk_id long, similarity double"


def cosine_top_k(queries: DataFrame, chunks: DataFrame, k: int, threshold: float = SIMILARITY_THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Exact nearest chunks of every query by cosine: ``(query_id, chunk_id, similarity)``.

    Inputs hold ``query_id`` / ``chunk_id`` (long) and ``vector``; rows that lack one have no neighbours. Both sides are
    cut into groups of about ``GROUP_BYTES`` of vectors, and each cell of their grid is a bounded piece of work for one
    task, which multiplies blocks of at most ``tile_bytes`` and returns at most k chunks per query. So all pairs are
    compared but never emitted, and smaller blocks make nothing travel more often. No vector reaches the driver.
    """
    queries, chunks = queries.where("query_id IS NOT NULL AND vector IS NOT NULL"), chunks.where("chunk_id IS NOT NULL AND vector IS NOT NULL")
    sizes = chunks.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    width = 8 * max(sizes["dim"] or 1, 1)
    rows = max(1, GROUP_BYTES // width)
    partial = _grid(queries, chunks, k, threshold, max(1, math.ceil(queries.count() / rows)), max(1, math.ceil(sizes["n"] / rows)), max(1, tile_bytes // width))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return partial.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _grid(queries: DataFrame, chunks: DataFrame, k: int, threshold: float, query_groups: int, chunk_groups: int, tile: int) -> DataFrame:
    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(query_groups)).cast("int").alias("qg")).withColumn("cg", spread(chunk_groups))
    c = chunks.select("chunk_id", "vector", F.pmod(F.xxhash64("chunk_id"), F.lit(chunk_groups)).cast("int").alias("cg")).withColumn("qg", spread(query_groups))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (query_ids, asking), (ids, held) = comparable(left, "query_id"), comparable(right, "chunk_id")
        best, numbers = KBest(len(query_ids), k, threshold), np.arange(len(query_ids))
        if len(query_ids) and len(ids):
            for low in range(0, len(ids), tile):
                block, names = held[low: low + tile], ids[low: low + tile]
                for first in range(0, len(query_ids), tile):
                    best.compare(asking[first: first + tile], numbers[first: first + tile], block, names)
        row, chunk, sim = best.found()
        return pd.DataFrame({"query_id": query_ids[row], "chunk_id": chunk, "similarity": sim}).astype({"query_id": "int64", "chunk_id": "int64", "similarity": "float64"})

    return q.groupBy("qg", "cg").cogroup(c.groupBy("qg", "cg")).applyInPandas(cell, _PAIR)


# ---------------------------------------------------------------- ranking


def normalise_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " ")


def evidence_score(text: Column, terms: Column) -> Column:
    """Share of the terms found in the text, both normalised; an empty term counts as not found."""
    body = normalise_text(text)
    found = F.filter(terms, lambda t: (normalise_text(t) != "") & F.contains(body, normalise_text(t)))
    return F.coalesce(F.try_divide(F.size(found).cast("double"), F.size(terms).cast("double")), F.lit(0.0))


def add_hybrid(candidates: DataFrame, text: str = "text", terms: str = "terms") -> DataFrame:
    scored = candidates.withColumn("evidence_score", evidence_score(F.col(text), F.col(terms)))
    # Rounded, so that a score on a limit does not hang on the last bit of a product.
    return scored.withColumn("hybrid_score", F.round(F.col("similarity") * SEMANTIC_WEIGHT + F.col("evidence_score") * EVIDENCE_WEIGHT, 9))


def diversify(candidates: DataFrame, k: int = TOP_K, query: str = "query_id", source: str = "source", chunk: str = "chunk_id") -> DataFrame:
    """Best chunk of each source first, then the best of the rest; the k chosen are ranked by score.

    Candidates per query are few (the cosine step limits them), so both windows are small.
    """
    best_first = [F.desc("hybrid_score"), F.col(chunk)]
    in_source = F.row_number().over(Window.partitionBy(query, source).orderBy(*best_first))
    marked = candidates.withColumn("_s", in_source)
    choice = F.row_number().over(Window.partitionBy(query).orderBy((F.col("_s") > 1).cast("int"), *best_first))
    chosen = marked.withColumn("_c", choice).where(F.col("_c") <= k)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*best_first))
    return chosen.withColumn("rank", rank).drop("_s", "_c")


def match_knowledge(retrieved: DataFrame, terms: str, text: str = "text", query: str = "query_id", chunk: str = "chunk_id") -> DataFrame:
    """Retrieved knowledge with a high enough score: which terms its text holds, matches first, at most five."""
    low = F.lower(F.col(text))
    tested = retrieved.where(F.col("hybrid_score") >= MIN_KNOWLEDGE_SCORE).withColumn("matched_terms", F.filter(terms, lambda t: F.contains(low, t)))
    tested = tested.withColumn("evidence_match", F.size("matched_terms") > 0)
    order = Window.partitionBy(query).orderBy(F.desc("evidence_match"), F.desc("hybrid_score"), chunk)
    return tested.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= MAX_SUPPORTING_KNOWLEDGE)


# ---------------------------------------------------------------- query text and terms

# Context fields named in a query, closing sentences, words that stand for nothing, trigger words.
CONTEXT_FIELDS = (
    "plan_id", "authorization_id", "reference_number", "issuer_name", "state", "plan_type", "metal_level", "patient_id", "provider_id", "payer_id",
    "authorization_type", "service_code", "service_description",
)
CLOSING = {
    "claims": "Find healthcare claims data quality validation rules, missing data patterns, suppressed values, root causes, and remediation procedures.",
    "authorization": "Find healthcare authorization validation rules, prior authorization anomalies, provider and payer data quality issues, and remediation procedures.",
    "pharmacy": "Find pharmacy claims validation rules, cost-per-claim anomalies, behavioral pattern changes, Bayesian anomaly guidance, and remediation procedures.",
}
EMPTY_TERMS = ("none", "null", "false", "unknown", "nan")
SUMMARY_TRIGGERS = (("isolation forest", "Isolation Forest"), ("xgboost", "XGBoost"), ("random forest", "Random Forest"), ("outlier", "outlier"))
BEHAVIOUR_TRIGGERS = (("cost per claim", "cost_per_claim"), ("historical", "historical_behavior"), ("behavior", "behavior"))
EXPLANATION_TRIGGERS = (
    ("missing", "missing"), ("missing", "completeness"), ("suppressed", "suppressed"), ("cost per claim", "cost_per_claim"), ("behavior", "behavior"),
    ("behavior", "historical_behavior"), ("provider", "provider"), ("authorization", "authorization"), ("claim", "claims"), ("pharmacy", "pharmacy"),
)
CONTEXT_TRIGGERS = (
    ("cost per claim", "cost_per_claim"), ("behavior", "behavior"), ("historical", "historical_behavior"), ("missing", "missing"), ("suppressed", "suppressed"),
)


def _sentence(label: str, value: Column, end: str = ".") -> Column:
    """``label value.`` when there is a value."""
    text = value.cast("string")
    return F.when(text.isNotNull() & (text != ""), F.concat(F.lit(label), text, F.lit(end)))


def _truth(c: Column) -> Column:
    return F.initcap(c.cast("string"))


def query_text(r: Column) -> Column:
    """One retrieval query from a canonical anomaly record."""
    d, ml, bayes = r["detection_summary"], r["ml_based_evidence"], r["bayesian_evidence"]
    rules, behaviour = r["rule_based_evidence"], r["behavioral_evidence"]
    dataset = F.coalesce(r["dataset_type"], F.lit("healthcare"))
    context = F.array_join(F.array_compact(F.array(*[
        F.when(F.try_element_at(r["record_context"], F.lit(f)) != "", F.concat(F.lit(f.replace("_", " ") + ": "), F.try_element_at(r["record_context"], F.lit(f))))
        for f in CONTEXT_FIELDS
    ])), "; ")
    closing = F.lit(None).cast("string")
    for name, text in CLOSING.items():
        closing = F.when(dataset == name, text).otherwise(closing)

    def texts(items: Column, field: str, separator: str) -> Column:
        return F.array_join(F.filter(F.transform(items, lambda x: x[field]), lambda t: t.isNotNull() & (t != "")), separator)

    return F.concat_ws(
        " ",
        F.concat(F.lit("Healthcare data quality anomaly in "), dataset, F.lit(" dataset.")),
        _sentence("Record ID: ", r["record_id"]),
        _sentence("Final anomaly: ", _truth(d["final_anomaly"])),
        _sentence("Severity: ", d["final_severity"]),
        _sentence("Risk score: ", d["final_risk_score"]),
        _sentence("Signal types: ", d["anomaly_type"]),
        _sentence("Rule violations: ", texts(rules, "rule_name", ", ")),
        _sentence("Rule reasons: ", texts(rules, "reason", "; ")),
        _sentence("ML model: ", ml["model"]),
        _sentence("ML anomaly: ", _truth(ml["is_anomaly"])),
        _sentence("ML anomaly score: ", ml["anomaly_score"]),
        _sentence("Contributing features: ", F.array_join(ml["contributing_features"], ", ")),
        _sentence("ML summary: ", ml["summary"]),
        _sentence("Bayesian anomaly: ", _truth(bayes["anomaly"])),
        _sentence("Bayesian probability: ", bayes["probability"]),
        _sentence("Bayesian score: ", bayes["score"]),
        F.when(F.size(behaviour) > 0, "Behavioral anomaly detected."),
        _sentence("Behavioral evidence: ", texts(behaviour, "description", "; ")),
        _sentence("Record context: ", context),
        _sentence("Detected pattern explanation: ", r["source_explanation"], ""),
        _sentence("SLA status: ", r["sla"]),
        closing,
    )


def _triggered(text: Column, triggers: Sequence[tuple[str, str]]) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(word)), F.lit(term)) for word, term in triggers]))


def evidence_terms(r: Column) -> Column:
    """Ordered distinct terms of a canonical anomaly record, for matching against knowledge text."""
    ml, behaviour = r["ml_based_evidence"], r["behavioral_evidence"]
    none = F.array().cast("array<string>")

    def or_none(c: Column) -> Column:
        return F.coalesce(c, none)

    per_item = F.flatten(F.transform(behaviour, lambda b: F.concat(F.array(b["type"]), or_none(_triggered(b["description"], BEHAVIOUR_TRIGGERS)))))
    parts = [
        F.array(r["dataset_type"]),
        or_none(F.split(r["detection_summary"]["anomaly_type"], ",")),
        F.transform(r["rule_based_evidence"], lambda x: x["rule_name"]),
        F.array(ml["model"]),
        or_none(ml["contributing_features"]),
        or_none(F.split(ml["types"], ",")),
        or_none(_triggered(ml["summary"], SUMMARY_TRIGGERS)),
        F.array(F.when(r["bayesian_evidence"]["anomaly"], "bayesian")),
        or_none(per_item),
        F.array(F.when(F.exists(behaviour, lambda b: b["detected"]), "behavioral")),
        or_none(_triggered(r["source_explanation"], EXPLANATION_TRIGGERS)),
        or_none(_triggered(F.try_element_at(r["record_context"], F.lit("context_for_rag")), CONTEXT_TRIGGERS)),
    ]
    trimmed = F.transform(F.array_compact(F.concat(*parts)), lambda t: F.trim(t))
    return F.array_distinct(F.filter(trimmed, lambda t: (t != "") & ~F.lower(t).isin(*EMPTY_TERMS)))
