"""Exact dedup and n-gram join against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.samples import documents, frame
from wardenframe.llm import components as graph
from wardenframe.llm import exact_dedup, ngram_join

WHITE = " \t\n\x0b\x0c\r"


def squeeze(text):
    return "".join(c for c in text or "" if c not in WHITE)


def expected_groups(rows):
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[squeeze(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, k))
    out = []
    for text, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def test_exact_groups(spark):
    rows = documents()
    found = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected_groups(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in found}


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []


def test_chunks_combine(spark, monkeypatch):
    rows = [(1, "abcdefgh" * 40, None, None, None), (2, "abcd efgh " * 40, None, None, None), (3, "abcdefgh" * 39 + "abcdefgx", None, None, None)]
    whole = exact_dedup.exact_groups(frame(spark, rows)).collect()
    monkeypatch.setattr(exact_dedup, "CHUNK", 7)
    cut = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert sorted(whole) == sorted(cut)
    assert {r.doc_id: r.keep_id for r in cut} == {1: 2, 2: 2, 3: 3}


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    """With a fingerprint that says nothing, texts of one size all meet, and the comparison tells them apart."""
    plain = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda rows: plain(rows).withColumns({"f0": plain_zero(), "f1": plain_zero()}))
    rows = [(k, t, None, None, None) for k, t in enumerate(["aa", "bb", "a a", "bb", "cc", "aa"])]
    found = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found} == {0: (2, 3, False), 1: (1, 2, True), 2: (2, 3, True), 3: (1, 2, False), 4: (4, 1, True), 5: (2, 3, False)}


def plain_zero():
    from pyspark.sql import functions as F
    return F.lit(0).cast("long")


def test_drop_exact_copies(spark):
    rows = documents()
    left = exact_dedup.drop_exact_copies(frame(spark, rows)).collect()
    assert Counter(squeeze(r.text) for r in left) == Counter({squeeze(r[1]) for r in rows})


def sets_of(rows, words=5):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    out = []
    for r in rows:
        w = (r[1] or "").encode().translate(lower).split()
        out.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return out


def expected_links(rows):
    sets, count = sets_of(rows), len(rows)
    root, links = list(range(count)), [0] * count

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(count):
        for b in range(a + 1, count):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return Counter((r[0], len(sets[k]), least.get(find(k)) if sets[k] else r[0], links[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("block", [256, 4])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = documents(150)
    found = ngram_join.ngram_links(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found) == expected_links(rows)


def test_links_with_hot_grams(spark, monkeypatch):
    """A passage that every text holds, a large group of near copies, and blocks that cut it."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(1)
    passage = " ".join(f"p{k}" for k in range(30))
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            words[at] = f"x{rng.integers(0, 3)}"
        rows.append((k, passage + " " + " ".join(words), None, None, None))
    rows += [(100 + k, passage + " " + " ".join(f"u{k}_{j}" for j in range(rng.integers(1, 60))), None, None, None) for k in range(40)]
    rows += [(200 + k, passage, None, None, None) for k in range(5)]
    found = ngram_join.ngram_links(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found) == expected_links(rows)


def test_links_of_nothing(spark):
    assert ngram_join.ngram_links(frame(spark, [])).collect() == []
    blank = ngram_join.ngram_links(frame(spark, [(3, None, None, None, None), (4, " ", None, None, None)])).collect()
    assert sorted(map(tuple, blank)) == [(3, 0, 3, 0), (4, 0, 4, 0)]


def test_gram_hashes_depend_on_words_alone():
    texts = ["A b\tC d e f", "a B c\n\nd E f", "a b c d", "A B C D ", "ab c d e f", None, ""]
    sets = list(ngram_join.gram_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 0, 0]
    assert (sets[0] == sets[1]).all() and (sets[2] == sets[3]).all()
    assert not np.isin(sets[4], sets[0]).any()


@pytest.mark.parametrize(("chunk", "one_task"), [(1 << 18, 1 << 18), (1 << 18, 0), (50, 0), (7, 40)])
def test_components(spark, monkeypatch, chunk, one_task):
    monkeypatch.setattr(graph, "CHUNK_EDGES", chunk)
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", one_task)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(64)] + [(2000, 2001 + k) for k in range(100)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    real = {x for a, b in edges if a != b for x in (a, b)}
    found = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == {x: root[x] for x in real} and len(found) == len(real)


def test_forest_ties_all():
    rng = np.random.default_rng(11)
    for count, edges in ((1, 0), (50, 20), (200, 150), (200, 400), (3000, 2500)) * 20:
        left, right = rng.integers(0, count, edges), rng.integers(0, count, edges)
        want = list(range(count))

        def find(x):
            while want[x] != x:
                x = want[x]
            return x

        for a, b in zip(left.tolist(), right.tolist()):
            a, b = find(a), find(b)
            want[max(a, b)] = min(a, b)
        assert graph.forest(count, left, right).tolist() == [find(x) for x in range(count)]


def test_components_by_name(spark):
    found = graph.components(spark.createDataFrame([("b:1", "a:9"), ("c", "b:1"), ("z", "z"), (None, "a:9"), ("x", "y")], "u string, v string")).collect()
    assert {r.node: r.root for r in found} == {"a:9": "a:9", "b:1": "a:9", "c": "a:9", "x": "x", "y": "x"}
    assert graph.components(spark.createDataFrame([], "u string, v string")).collect() == []


def test_common_by_slices(monkeypatch):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 300)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for limit in (1 << 22, 900, 100):
        monkeypatch.setattr(ngram_join, "SLICE_GRAMS", limit)
        got = ngram_join._common(sets, width=64)
        assert all(got[a, b] == want[a][b] for a in range(30) for b in range(30) if a != b)
