"""The pipeline's stages on a small corpus, each compared with brute force on its own input."""

import random

import pytest

from tests.llm.samples import WORDS, frame, prose
from tests.llm.test_dedup_and_join import expected_groups, expected_links, squeeze
from wardenframe.llm.common import fresh_path, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(260):
        lang = rng.choice(list(WORDS))
        text = prose(rng, lang, rng.randint(30, 120))
        if k % 10 == 3:
            text = text.upper() + " ###"
        elif k % 10 == 5 and rows:
            text = rows[-1][1].replace(" ", "\n", 2)
        elif k % 10 == 7 and rows:
            text = rows[-1][1] + " appended"
        rows.append((k, text, lang, "s", len(text)))
        labels.append((k, int("###" not in text), 0))
    rows += [(300, None, "en", None, None), (301, "123 !!", "en", None, 6), rows[0], (302, "", None, None, 0), (0, "the same key but another text that is long enough to stand for itself", "en", "s", 70)]
    path = fresh_path(spark, "test-tables")
    frame(spark, rows).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_classifier", "exact_dedup", "ngram_jaccard", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [[tuple(r) for r in docs.select(*COLUMNS).collect()]]
    for name, stage in pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS
        kept.append([tuple(r) for r in docs.collect()])
    first, spoken, good, distinct, apart = kept
    assert {r[0] for r in first} - {r[0] for r in spoken} == {300, 301, 302}
    clean = {r[0] for r in spoken if "###" not in r[1]}
    assert len({r[0] for r in good} & clean) >= 0.97 * len(clean) and not any("###" in r[1] for r in good)
    assert sorted(squeeze(r[1]) for r in distinct) == sorted({squeeze(r[1]) for r in good})
    stays = {(keep, sha) for _, keep, _, sha in expected_groups(good)}
    assert len(distinct) == len(stays) and {r[0] for r in distinct} == {k for k, _ in stays}
    roots = {c for _, _, c, _ in expected_links(distinct)}
    assert {r[0] for r in apart} == roots
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r.piece_tokens for r in packed) == sum(len(r[1].split()) for r in apart)
    assert sorted(tuple(r) for r in pipeline.run(spark, folder).select("doc_id", "piece", "piece_tokens").collect()) == sorted((r.doc_id, r.piece, r.piece_tokens) for r in packed)


def test_stages_of_nothing(spark, folder):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for name, stage in pipeline.STAGES:
        docs = saved(stage(spark, docs, folder), name)
        assert docs.count() == 0
