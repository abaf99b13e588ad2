"""Corpus pipeline: language ID, quality classifier, exact dedup, n-gram Jaccard join, best-fit packing.

Every stage takes (spark, documents, folder of the tables) and works on all rows that the one before kept.
The first four return documents with all their columns; the last one returns their packed pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import saved, table, text_remainder
from wardenframe.llm.exact_dedup import drop_exact_copies
from wardenframe.llm.language import UNKNOWN, learn_languages, predict_languages
from wardenframe.llm.ngram_join import ngram_links
from wardenframe.llm.packing import pack_sequences, text_words
from wardenframe.llm.quality import quality_scores

#: A document goes if no language holds this proportion of it, or if its quality score is below the other.
LEAST_SHARE, LEAST_QUALITY = 0.35, 0.5


def _row_name() -> Column:
    """Name of a row: documents that share a doc_id are told apart by their texts."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


def _keep(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Documents whose row name is among the distinct `names`."""
    kept = names.select(F.col("row.id").alias("_id"), F.col("row.text").alias("_text")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_text")), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language that holds `LEAST_SHARE` of them."""
    rows = docs.select(_row_name().alias("row"), "text", "lang", "doc_id")
    names, likelihood = learn_languages(rows.filter(text_remainder("doc_id", 4) != 2))
    found = predict_languages(rows, names, likelihood, key="row")
    return _keep(docs, found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least `LEAST_QUALITY`."""
    learn = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 <> 1"
    scores = quality_scores(docs.select("doc_id", "text", _row_name().alias("row")), table(spark, sf_dir, "labels"), learn=learn, carry="row")
    return _keep(docs, scores.filter(F.col("score") >= LEAST_QUALITY))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id."""
    return drop_exact_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that similarity links."""
    linked = ngram_links(docs.select(_row_name().alias("row"), "text"), key="row")
    return _keep(docs, linked.filter(F.col("row") == F.col("component_id")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of the permitted lengths, in words."""
    return pack_sequences(text_words(docs), "doc_id", "n_words")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: Language, quality and similarity stages have no SQL form; `tests/llm` compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
