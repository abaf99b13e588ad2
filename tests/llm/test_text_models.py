"""Tokeniser round trip, language and quality accuracy, divergence rules, sharding and packing laws."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.samples import WORDS, documents, frame, prose
from wardenframe.llm import bpe, divergence, language, packing, quality, sharding

RANKS = {bytes([k]): k for k in range(256)} | {b"th": 256, b"the": 257, b" the": 258, b"in": 259, b"xx": 260, b"xxxx": 261, b" r": 262}
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.mark.parametrize("block", [16_000_000, 500])
def test_encode_and_decode(spark, monkeypatch, block):
    import tiktoken

    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    whole = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rows = documents(60)
    found = bpe.decode_ids(bpe.encode_texts(frame(spark, rows), RANKS, PATTERN), RANKS).collect()
    expected = Counter((r[0], tuple(whole.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in found) == expected
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)


def test_encode_nothing(spark):
    assert bpe.decode_ids(bpe.encode_texts(frame(spark, []), RANKS, PATTERN), RANKS).collect() == []
    only_empty = bpe.encode_texts(frame(spark, [(1, None, None, None, None), (2, "", None, None, None)]), RANKS, PATTERN).collect()
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in only_empty) == [(1, 0, b""), (2, 0, b"")]


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    learn = [(k, prose(rng, lang, 30), lang, None, None) for k in range(80) for lang in WORDS]
    names, likelihood = language.learn_languages(frame(spark, learn))
    assert names == sorted(WORDS) and np.allclose(likelihood.sum(axis=1), 1)
    test = [(k, prose(rng, lang, 25), lang, None, None) for k, lang in enumerate(list(WORDS) * 20)]
    found = language.predict_languages(frame(spark, test), names, likelihood).collect()
    assert np.mean([r.lang_pred == test[r.doc_id][2] for r in found]) >= 0.97
    mixed = [(1, prose(rng, "en", 120) + " " + prose(rng, "de", 60), None, None, None), (2, None, None, None, None), (3, "12 #!", None, None, None), (4, "", None, None, None)]
    got = {r.doc_id: r for r in language.predict_languages(frame(spark, mixed), names, likelihood).collect()}
    assert got[1].lang_pred == "en" and set(got[1].shares) == {"en", "de"} and 0.5 < got[1].score < 0.85
    assert all((got[k].lang_pred, got[k].score, got[k].shares) == ("und", 0, {}) for k in (2, 3, 4))


def test_language_without_learning_rows_or_documents(spark):
    names, likelihood = language.learn_languages(frame(spark, []))
    assert names == [] and len(language.predict_languages(frame(spark, documents(10)), names, likelihood).filter("lang_pred <> 'und'").collect()) == 0
    assert language.predict_languages(frame(spark, []), names, likelihood).collect() == []


def test_mixture_beats_every_other_proportion():
    rng = np.random.default_rng(0)
    likelihood = rng.dirichlet(np.ones(language.BINS), 3)
    counts = (rng.multinomial(400, likelihood[0]) + rng.multinomial(200, likelihood[2])).astype(np.float32)[None]
    found = language.mixtures(counts, likelihood, rounds=200)[0]
    assert found[1] == 0 and abs(found[0] - 2 / 3) < 0.06
    value = lambda w: counts[0] @ np.log(w @ likelihood)
    assert all(value(found) >= value(np.array([w, 0, 1 - w])) - 0.05 for w in np.linspace(0.01, 0.99, 99))


@pytest.mark.parametrize("languages", [1, 3, 5, 8])
def test_as_many_languages_as_a_text_holds(languages):
    rng = np.random.default_rng(languages)
    likelihood = rng.dirichlet(np.full(language.BINS, 0.05), 40) + 1e-7
    likelihood /= likelihood.sum(axis=1, keepdims=True)
    inside = rng.choice(40, languages, replace=False)
    counts = sum(rng.multinomial(600, likelihood[k]) for k in inside).astype(np.float32)[None]
    found = language.mixtures(counts, likelihood)[0]
    assert set(np.flatnonzero(found > 0)) == set(inside)
    assert abs(found[inside] - 1 / languages).max() < 0.05


def test_chosen_sets_are_the_best_of_all():
    """Every set of six languages, by brute force: none has a better penalised likelihood."""
    from itertools import combinations

    rng = np.random.default_rng(12)
    likelihood = rng.dirichlet(np.full(language.BINS, 0.2), 6) + 1e-6
    likelihood /= likelihood.sum(axis=1, keepdims=True)
    rows = []
    for _ in range(25):
        inside = rng.choice(6, rng.integers(1, 5), replace=False)
        rows.append(sum(rng.multinomial(rng.integers(10, 400), likelihood[k]) for k in inside))
    counts = np.array(rows, np.float32)
    found = language.mixtures(counts, likelihood, rounds=60)
    for row, weights in zip(counts.astype(float), found):
        unit = language.PRICE * np.log(row.sum() + 1) / 2
        best = -np.inf
        for size in range(1, 7):
            for chosen in combinations(range(6), size):
                part, w = likelihood[list(chosen)], np.full(size, 1 / size)
                for _ in range(300):
                    w = w * ((row / (w @ part)) @ part.T) / row.sum()
                best = max(best, row @ np.log(w @ part) - size * unit)
        assert row @ np.log(weights @ likelihood) - (weights > 0).sum() * unit >= best - 0.05


def test_quality_of_held_out_texts(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.7
        text = prose(rng, rng.choice(list(WORDS)), rng.randint(20, 90))
        rows.append((k, text if good else rng.choice([text.upper() + "!!", " ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * 60)]), None, None, None))
        labels.append((k, int(good)))
    labels += [(5000, 1), (None, 0), (3, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    extra = [(9000, None, None, None, None), (9001, "", None, None, None), (9001, "", None, None, None), (None, "words", None, None, None)]
    found = quality.quality_scores(frame(spark, rows + extra), table, learn="doc_id % 2 = 0").collect()
    assert len(found) == len(rows) + 4 and all(0 <= r.score <= 1 for r in found)
    scores = {r.doc_id: r.score for r in found}
    assert np.mean([(scores[k] >= 0.5) == bool(y) for k, y in labels[:400] if k % 2]) >= 0.95
    assert scores[9000] == scores[9001]


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(frame(spark, documents(5)), none).collect()} == {0.5}
    assert quality.quality_scores(frame(spark, []), none).collect() == []


def test_isotonic_steps():
    points, values = quality.isotonic(np.arange(5.0), np.array([0, 5, 2, 9, 8.0]), np.array([10, 10, 10, 10, 10.0]))
    assert (np.diff(values) >= 0).all() and points[0] == 0 and points[-1] == 4
    assert abs(np.interp(1.5, points, values) - 7.5 / 21) < 1e-9


def brute_counts(text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_divergence_counts_and_verdict(spark):
    rng = random.Random(6)
    rows = documents(60) + [(700, "a b c a b c d e\nx\nx\n \nx", "en", None, None), (701, " ".join(w.upper() for w in prose(rng, "en", 90).split()), "en", None, None)]
    rows += [(800 + k, " ".join(f"{w}{rng.randint(0, 99)}" if 0 else w for w in prose(rng, "en", 90).split()) + f" end{k}", "en", None, None) for k in range(40)]
    found = divergence.divergence_rules(frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in found) == Counter((r[0], *brute_counts(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert not any(r.kept and r.base_failed for r in found)
    verdict = {r.doc_id: r for r in found}
    assert not verdict[701].kept and not verdict[701].base_failed and verdict[701].class_distance > divergence.MAX_CLASS_DISTANCE
    assert all(verdict[800 + k].kept or verdict[800 + k].base_failed for k in range(40))
    assert divergence.divergence_rules(frame(spark, [])).collect() == []


def test_js_distance(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, DoubleType

    kind = ArrayType(DoubleType())
    row = spark.range(1).select(*[divergence.js_distance(F.lit(a).cast(kind), F.lit(b).cast(kind)).alias(n) for n, a, b in (("same", [0.5, 0.5], [0.5, 0.5]), ("apart", [1.0, 0.0], [0.0, 1.0]), ("near", [0.6, 0.4], [0.4, 0.6]))]).first()
    assert row.same == 0 and row.apart == 1 and 0 < row.near < 0.3


@pytest.mark.parametrize("bits,dimensions", [(1, 2), (2, 2), (3, 2), (2, 3), (1, 1), (3, 1)])
def test_curve_visits_neighbours(spark, bits, dimensions):
    """Each index once, and consecutive cells differ by one step in one dimension: that makes it a Hilbert curve."""
    from pyspark.sql import functions as F

    cells = spark.range(1 << (bits * dimensions)).select(F.array(*[F.expr(f"(id >> {bits * d}) & {(1 << bits) - 1}") for d in range(dimensions)]).alias("x"))
    found = sorted((r.h, r.x) for r in cells.select("x", sharding.curve_index(F.col("x"), dimensions, bits).alias("h")).collect())
    assert [h for h, _ in found] == list(range(1 << (bits * dimensions)))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(found, found[1:]))


@pytest.mark.parametrize("shards", [1, 7, 16, 500])
def test_shards_are_even_and_gapless(spark, shards):
    rows = documents()
    found = sharding.hilbert_shards(frame(spark, rows), ["source", "lang", "n_chars"], "doc_id", shards).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, ())) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    order = [r.curve for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_of_nothing(spark):
    assert sharding.hilbert_shards(frame(spark, []), ["source", "n_chars"], "doc_id", 4).collect() == []


def test_sources_with_a_common_prefix_are_told_apart(spark):
    rows = [(k, "text", "en", f"https://example.org/{'ab'[k % 2]}", 1) for k in range(200)]
    found = sharding.hilbert_shards(frame(spark, rows), ["source"], "doc_id", 2).collect()
    assert {(r.shard, r.doc_id % 2) for r in found} == {(0, 0), (1, 1)}


def test_text_steps_are_exact_quantiles_of_whole_values(spark):
    values = [f"common_crawl_{k * 7919 % 601:03d}" for k in range(601)] + ["common_crawl_300"] * 150 + [None] * 90 + ["", "é" * 50, "é" * 50 + "a"]
    rows = [(k, "text", "en", v, 1) for k, v in enumerate(values)]
    found = sharding.hilbert_shards(frame(spark, rows), ["source"], "doc_id", 4).collect()
    ordered = sorted(b"0" if v is None else b"1" + v.encode() for v in values)
    cuts = sorted({ordered[-(-s * len(ordered) // 16) - 1] for s in range(1, 16)})
    steps = [sum((b"0" if v is None else b"1" + v.encode()) > c for c in cuts) for v in values]
    assert {r.doc_id: r.curve for r in found} == dict(enumerate(steps))


def test_packing_keeps_every_piece_and_length(spark):
    rows = documents()
    words = packing.text_words(frame(spark, rows))
    found = packing.pack_sequences(words, "doc_id", "n_words", (16, 32, 64), overhead=4, group_pieces=40).collect()
    assert sum(r.piece_tokens for r in found) == sum(len((r[1] or "").split()) for r in rows)
    bins = defaultdict(list)
    for r in found:
        bins[r.pack_group, r.bin_id].append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: (r.bin_offset, r.piece_tokens)):
            assert r.bin_offset == at
            at += r.piece_tokens
        assert {r.bin_length for r in members} == {min(c for c in (16, 32, 64) if c >= at)}
    starts = defaultdict(list)
    for r in found:
        starts[r.doc_id].append((r.piece, r.piece_start))
    assert {r[0] for r in rows} == set(starts) and all(s == p * 64 for v in starts.values() for p, s in v)
    assert packing.pack_sequences(packing.text_words(frame(spark, [])), "doc_id", "n_words").collect() == []
    odd = spark.createDataFrame([(1, None), (2, -5), (3, 0)], "doc_id long, n_words int")
    assert all(r.piece_tokens == 0 for r in packing.pack_sequences(odd, "doc_id", "n_words").collect())


def test_best_fit_against_search():
    """Every piece goes to the open bin with the least room, found by plain search."""
    rng = random.Random(1)
    sizes = sorted((rng.randint(0, 60) for _ in range(200)), reverse=True)
    bins, offsets, lengths = packing.best_fit(sizes, (16, 32, 64), 4)
    room, capacity, rest = {}, {}, sum(sizes)
    for size, b, at in zip(sizes, bins, offsets):
        fitting = [(left, k) for k, left in room.items() if left >= size]
        if fitting:
            assert b == min(fitting)[1]
        else:
            assert b not in room
            room[b] = capacity[b] = packing.opening_length(size, max(rest, 1), (16, 32, 64), 4)
        assert at == capacity[b] - room[b]
        room[b] -= size
        rest -= size
    assert packing.opening_length(10, 10, (16, 32, 64), 4) == 16 and packing.opening_length(10, 1000, (16, 32, 64), 4) == 64


def test_statistics_of_odd_texts():
    found = quality.text_statistics(pa.array([None, "", " \n", "AB cd\nAB cd", "é" * 5]))
    assert (found[:2] == 0).all() and not found[2, : quality.STATISTICS.index("line")].any() and found[3, quality.STATISTICS.index("distinct_lines")] == 0.5
