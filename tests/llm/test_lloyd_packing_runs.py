"""Dimension-sharded Lloyd, retrieval packing and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.samples import documents, frame
from wardenframe.llm import lloyd, retrieval_packing, runs

VECTORS = "vec_id long, embedding array<float>, cluster int, distance long, block long, dim int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, 2, 3, 4) for k, v in rows], VECTORS)


def brute_lloyd(rows, dims, clusters, rounds):
    kept = [(k, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for k, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda k: (k is None, hashlib.sha256(f"2:{k}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        near = [min((far(v, c), k) for k, c in enumerate(centres)) for _, v in kept]
        if n < rounds:
            groups = defaultdict(list)
            for (_, v), (_, k) in zip(kept, near):
                groups[k].append(v)
            centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if groups[k] else c for k, c in enumerate(centres)]
    return Counter((k, c, d) for (k, _), (d, c) in zip(kept, near)), centres


@pytest.mark.parametrize(("dims", "width", "block"), [(6, 4, 1024), (6, 2, 7), (5, 8, 3)])
def test_lloyd(spark, monkeypatch, dims, width, block):
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", block)
    rng = np.random.default_rng(dims * width)
    rows = [(k, (rng.normal(size=dims) + 3 * (k % 4)).tolist()) for k in range(90)]
    rows += [rows[3], rows[3], (200, rows[5][1]), (None, rows[6][1]), (201, None), (202, [1.0] * (dims + 1)), (203, []), (204, [float("nan")] * dims), (205, [None] * dims), (206, [float("inf")] + [0.0] * (dims - 1)), (207, [-0.001] * dims), (208, [0.0] * dims)]
    found, centres = lloyd.lloyd_by_columns(vectors(spark, rows), dims=dims, clusters=9, rounds=3, width=width)
    expected, expected_centres = brute_lloyd(rows, dims, 9, 3)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == expected
    assert {(r.cluster, r.dim): r.value for r in centres.collect()} == {(k, d): v for k, c in enumerate(expected_centres) for d, v in enumerate(c)}


def test_lloyd_of_little(spark):
    found, centres = lloyd.lloyd_by_columns(vectors(spark, []), dims=2)
    assert found.columns == ["vec_id", "cluster", "distance"] and found.collect() == [] and centres.collect() == []
    found, centres = lloyd.lloyd_by_columns(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]), dims=2, clusters=40, rounds=2)
    assert [(r.cluster, r.distance) for r in found.collect()] == [(0, 0), (0, 0)]
    assert Counter(r.cluster for r in centres.collect()) == {0: 2, 1: 2}  # the empty one stays


def test_lloyd_is_exact_or_says_so(spark):
    big = float(lloyd.largest_component(2) // 512)
    found, _ = lloyd.lloyd_by_columns(vectors(spark, [(1, [big, big]), (2, [-big, -big]), (3, [big, -big])]), dims=2, clusters=1, rounds=1)
    assert sum(r.distance for r in found.collect()) > 2**53
    with pytest.raises(Exception, match="too large for exact distances"):
        lloyd.lloyd_by_columns(vectors(spark, [(1, [1e30, 0.0])]), dims=2)
    points, centres = np.array([[2**27, -(2**27)]]), np.array([[-(2**27), 2**27], [2**27, 0]])
    assert lloyd.partial_distances(points, centres).tolist() == [[2 * (2**28) ** 2, (2**27) ** 2]]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_ids_are_those_of_the_library():
    import public_tokenizers

    tokenizer = library()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = retrieval_packing.Encoder(file.read())
    rng = random.Random(0)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "a", "Z", "é", "ß", "ª", "²", "9", "12", ".", "!!", "-", "—", "’", "…", "<|endoftext|>"]
    rare = ["日", "😀", "ا", "́", " ", "　"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts if rng.random() < 0.9 else rare) for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 60]))) for _ in range(rng.randrange(8))]
        assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    single = [f"a{c}b {c}1{c}{c} {c}'s" for c in map(chr, np.flatnonzero(encoder.kind != retrieval_packing._UNKNOWN).tolist())]
    assert [x.tolist() for x in encoder.encode(single)] == [x.ids for x in tokenizer.encode_batch(single, add_special_tokens=False)]


def pack(spark, rows, **more):
    import public_tokenizers

    return retrieval_packing.pack_by_retrieval(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), **more).collect()


def check_packing(rows, found, window):
    """Every id of every row in exactly one piece, sequences without gaps, no padding but at powers of two."""
    tokenizer = library()
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows]
    own = defaultdict(list)
    for r in found:
        own[r.doc_id].append(r)
    for key in {r[0] for r in rows}:
        wanted = Counter()
        documents_of_key = [x for r, x in zip(rows, ids) if r[0] == key]
        # Repeated keys with different texts are told apart by their sizes; equal rows give equal pieces of the whole.
        for x in documents_of_key:
            wanted[len(x)] += len(x)
        assert Counter({n: sum(r.length for r in own[key] if r.doc_tokens == n) for n in wanted}) == wanted
        if len(documents_of_key) == 1:
            at = 0
            for r in sorted(own[key], key=lambda r: r.start):
                part = np.array(documents_of_key[0][r.start: r.start + r.length], "<u4")
                assert r.start == at and len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32
                at += r.length
            assert at == len(documents_of_key[0])
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    return sequences


@pytest.mark.parametrize(("window", "shard"), [(1024, 2048), (64, 8), (50, 1)])
def test_retrieval_packing(spark, monkeypatch, window, shard):
    monkeypatch.setattr(retrieval_packing, "SHARD_TAILS", shard)
    rows = documents()
    found = pack(spark, rows, window=window)
    sequences = check_packing(rows, found, window)
    short = sum(sum(n for _, n in parts) < window for parts in sequences.values())
    assert short <= 10 and all(r.doc_tokens >= 1 for r in found)


def test_packing_of_little(spark):
    assert pack(spark, []) == []
    found = pack(spark, [(1, None, None, None, None), (2, "", None, None, None)])
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in found) == [(1, 0, 1, 1), (2, 0, 1, 1)]
    assert {r.ids_crc32 for r in found} == {zlib.crc32(b"\0\0\0\0")}


def test_scores_are_bm25():
    rng = np.random.default_rng(2)
    pieces = [rng.zipf(1.5, rng.integers(1, 60)) % 50 for _ in range(40)]
    _, token, _ = retrieval_packing._bags(pieces)
    names, df = np.unique(token, return_counts=True)
    lengths = np.array([len(p) for p in pieces])
    statistics = retrieval_packing.Statistics.of(names, df, len(pieces), lengths.sum())
    index = retrieval_packing.Index(pieces, statistics)
    for query in pieces[:10]:
        expected = []
        for p in pieces:
            score = 0.0
            for t in set(query.tolist()):
                tf, n = int((p == t).sum()), sum(t in q for q in pieces)
                score += np.log(1 + (40 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(p) / lengths.mean()))
            expected.append(score)
        assert np.allclose(index.scores(query), expected)
    assert not index.scores(np.array([99])).any()
    assert all(np.allclose(index.scores_for(k), index.scores(p)) for k, p in enumerate(pieces))
    free = np.arange(40) % 3 > 0
    before = index.scores(pieces[0])
    index.keep(free)
    assert np.allclose(index.scores(pieces[0]), np.where(free, before, 0)) and np.allclose(index.scores_for(0), np.where(free, before, 0))


def test_windows_take_the_best_unused_neighbours(monkeypatch):
    monkeypatch.setattr(retrieval_packing, "_sequence", lambda count, kind: count)
    rng = np.random.default_rng(4)
    tails = [retrieval_packing._Tail(k, 0, 20, (k % 5) * 100 + rng.integers(0, 30, 20)) for k in range(50)]
    names, df = np.unique(retrieval_packing._bags([t.ids for t in tails])[1], return_counts=True)
    packer = retrieval_packing.Packer(retrieval_packing.Statistics.of(names, df, 50, 1000), 100)
    packer.shard(tails)
    packer.finish()
    windows = defaultdict(list)
    for key, *_, sequence, _ in packer.rows:
        windows[sequence].append(key)
    assert len(windows) == 10 and all(len({k % 5 for k in keys}) == 1 for keys in windows.values())


def brute_runs(words, least=6, periods=4):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


word_lists = st.lists(st.one_of(
    st.lists(st.integers(0, 2), max_size=40),
    st.builds(lambda a, p, n, b: a + p * n + b, st.lists(st.integers(0, 4), max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(2, 9), st.lists(st.integers(0, 4), max_size=12)),
), min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(word_lists, st.sampled_from([(6, 4), (6, 4), (4, 3), (2, 2), (9, 2)]))
def test_runs_of_any_words(texts, law):
    numbers, starts = runs.word_numbers(texts)
    found, owner = runs.find_runs(numbers, starts, *law)
    for k, words in enumerate(texts):
        assert [tuple(r) for r in found[owner == k].tolist()] == brute_runs(words, *law)


def test_long_runs_are_quick():
    for words in (["a"] * 50000, ["a", "b", "a", "c"] * 20000, [f"w{k % 9000}" for k in range(60000)]):
        numbers, starts = runs.word_numbers([words])
        found, _ = runs.find_runs(numbers, starts)
        assert found.tolist() == [[0, len(words), len(set(words)) if len(set(words)) != 3 else 4]]


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_word_runs(spark, monkeypatch):
    monkeypatch.setattr(runs, "STEP_BYTES", 4000)
    rows = documents()
    rows += [(300, "x " * 9, None, None, None), (301, "a b c\n" * 5 + "a b", None, None, None), (302, "é ü " * 4 + "\xa0 z", None, None, None), (303, " ".join(["p"] * 6 + ["q"] * 7), None, None, None)]
    found = runs.word_runs(frame(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found)
    want = Counter()
    for r in rows:
        words = [w.decode() for w in (r[1] or "").encode().split()]
        # The longest texts hold no runs of long periods: brute force looks at short ones.
        own = brute_runs(words) if len(words) < 5000 else [x for x in brute_runs(words[:20000]) if x[1] + x[0] < 20000]
        if len(words) < 5000:
            want[(r[0], len(words), tuple(own), collapsed(words, own))] += 1
    assert {k: v for k, v in got.items() if k[1] < 5000} == dict(want)
    assert sum(k[1] >= 5000 for k in got) == 1
    assert runs.word_runs(frame(spark, [])).collect() == []


def test_loops_are_planted_as_stated(spark):
    rows = documents()
    found = Counter((r.doc_id, r.text) for r in runs.looped_texts(frame(spark, rows)).collect())
    want, changed = Counter(), 0
    for key, text, *_ in rows:
        h = zlib.crc32(str(key).encode())
        words = [w.decode() for w in (text or "").encode().split()]
        if key is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text, changed = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)), changed + 1
        want[(key, text)] += 1
    assert found == want and changed > 3
