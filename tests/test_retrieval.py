import numpy as np
from pyspark.sql import functions as F

from wardenframe.operators import advice as ad
from wardenframe.operators import retrieval as rt
from wardenframe.operators import vector_index as vi


def by_hand(text, size, overlap):
    text, out, start = text.strip(), [], 0
    while text and start < len(text):
        end = min(start + size, len(text))
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = end - overlap
    return out


def test_chunks_cover_whole_texts(spark):
    texts = ["", "  ", "short", "x" * 800, "y" * 801, "ab " * 700 + "　", "word " * 5000, "a" + " " * 2000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {}
    for r in rt.chunk_documents(df, "body", ["id"]).orderBy("id", "chunk_id").collect():
        got.setdefault(r.id, []).append(r.text)
    for i, t in enumerate(texts):
        assert got.get(i, []) == by_hand(t, 800, 120)


def test_both_cosine_paths_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(40, 8)), rng.normal(size=(300, 8))
    q[0] = 0
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, vector array<double>")
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "chunk_id long, vector array<double>")
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    sim = unit(q) @ unit(c).T
    want = {i: [int(j) for j in np.argsort(-s, kind="stable")[:7] if s[j] >= 0.35] for i, s in enumerate(sim)}
    for limits in ({}, {"tile_bytes": 2000}):
        got = {i: [] for i in range(40)}
        for r in rt.cosine_top_k(queries, chunks, 7, **limits).orderBy("query_id", F.desc("similarity"), "chunk_id").collect():
            got[r.query_id].append(r.chunk_id)
        assert got == want
    assert want[0] == []


def test_diversity_takes_each_source_first(spark):
    rows = [(1, i, "a", 0.9 - i / 100) for i in range(5)] + [(1, 9, "b", 0.1)]
    got = rt.diversify(spark.createDataFrame(rows, "query_id long, chunk_id long, source string, hybrid_score double"), 5)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 9]


def test_evidence_score_is_the_share_of_terms_found(spark):
    df = spark.createDataFrame([("Cost-per-claim check", ["cost per claim", "", "absent"]), ("x", [])], "t string, terms array<string>")
    assert [round(r[0], 6) for r in df.select(rt.evidence_score(F.col("t"), F.col("terms"))).collect()] == [0.333333, 0.0]


def test_priority_is_raised_by_risk(spark):
    df = spark.createDataFrame([("low", 0.9), ("low", 0.8), ("critical", 0.8), ("odd", None)], "s string, r double")
    assert [r[0] for r in df.select(ad.priority(F.col("s"), F.col("r"))).collect()] == ["Critical", "High", "Critical", "Normal"]


def _vectors(spark, name, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, vector array<double>")


def _awkward_vectors():
    """Clusters, a vector that a third of the rows share, scaled copies, zero and null vectors."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(k, centres[k % 12] + 0.4 * rng.normal(size=16)) for k in range(600)]
    hot = rows[5][1]
    rows += [(1000 + k, hot) for k in range(300)] + [(2000 + k, hot * (2 + k)) for k in range(5)] + [(3000, np.zeros(16)), (3001, np.zeros(16)), (3002, None)]
    return rows


def _brute(rows, queries, k, threshold):
    ids = np.array([i for i, v in rows if v is not None])
    m = np.array([v for _, v in rows if v is not None])
    unit = lambda x: x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    out = {}
    for i, v in queries:
        if v is not None:
            sim = np.round((unit(m) @ unit(np.array([v])).T)[:, 0], 9)
            hits = np.flatnonzero(sim >= threshold)
            out[i] = [(int(ids[h]), float(sim[h])) for h in hits[np.lexsort((ids[hits], -sim[hits]))[:k]]]
    return out


def test_index_search_is_exact(spark):
    rows = _awkward_vectors()
    queries = [(k, v) for k, v in rows if k % 20 == 0] + [(9000, rows[5][1]), (9001, None)]
    index = vi.build_index(_vectors(spark, "chunk_id", rows), cells=15)
    assert sum(index.entries.values()) == 600 + 5 + 1  # copies are one entry, null vectors none
    for k, threshold, tile in ((7, 0.35, 4 << 20), (3, -0.2, 1000), (400, 0.9, 4 << 20)):
        want = _brute(rows, queries, k, threshold)
        got = {i: [] for i in want}
        for r in vi.search_index(index, _vectors(spark, "query_id", queries), k, threshold, probes=2, tile_bytes=tile).collect():
            got[r.query_id].append((r.chunk_id, round(r.similarity, 9)))
        for i, expected in want.items():
            found = sorted(got[i], key=lambda x: (-x[1], x[0]))
            assert [s for _, s in found] == [s for _, s in expected]
            # Ties that floating point splits aside, the neighbours are the same.
            if len({s for _, s in expected}) == len(expected):
                assert found == expected


def test_index_recall_by_tuned_probes(spark):
    rows = _awkward_vectors()
    chunks, queries = _vectors(spark, "chunk_id", rows), _vectors(spark, "query_id", [(k, v) for k, v in rows if k % 20 == 0])
    index = vi.build_index(chunks)
    probes = vi.tuned_probes(index, queries, 10)
    assert 1 <= probes <= len(index.entries)
    measured = vi.recall(vi.search_index(index, queries, 10, probes=probes, exact=False), rt.cosine_top_k(queries, chunks.where("vector IS NOT NULL"), 10)).first()
    assert measured.recall >= 0.9


def test_index_of_nothing(spark):
    empty = vi.build_index(_vectors(spark, "chunk_id", []))
    assert vi.search_index(empty, _vectors(spark, "query_id", [(1, [1.0, 0.0])]), 3).collect() == []
    index = vi.build_index(_vectors(spark, "chunk_id", [(4, [0.0, 0.0]), (5, [1.0, 1.0])]))
    assert vi.search_index(index, _vectors(spark, "query_id", []), 3).collect() == []
    assert [r.chunk_id for r in vi.search_index(index, _vectors(spark, "query_id", [(1, [2.0, 2.0])]), 3).collect()] == [5]


def test_k_best_hold_few_products_at_once():
    import tracemalloc

    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(3000, 8)), rng.normal(size=(4000, 8))
    left, right = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (left, right))
    sim = left @ right.T
    want = [np.lexsort((np.arange(4000), -s))[:5].tolist() for s in sim]
    for tile in (4000, 300):
        tracemalloc.start()
        best = rt.KBest(3000, 5, -0.2)
        for low in range(0, 4000, tile):
            best.compare(left, np.arange(3000), right[low: low + tile], np.arange(low, min(low + tile, 4000)))
        row, ids, _ = best.found()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < sim.nbytes / 2  # all products at once are 96 MB
        assert row.tolist() == np.repeat(np.arange(3000), 5).tolist()
        assert ids.reshape(3000, 5).tolist() == want


def test_small_blocks_travel_no_more_often(spark):
    rng = np.random.default_rng(4)
    chunks = _vectors(spark, "chunk_id", [*enumerate(rng.normal(size=(200, 4))), (500, None)])
    queries = _vectors(spark, "query_id", enumerate(rng.normal(size=(50, 4))))
    plans = [rt.cosine_top_k(queries, chunks, 3, tile_bytes=t)._jdf.queryExecution().optimizedPlan().toString() for t in (64, 1 << 20)]
    # Rows are repeated by literal lists of group numbers, which were as long as the number of blocks.
    assert max(p.count("explode([0,") for p in plans) == 0
    got = [sorted(map(tuple, rt.cosine_top_k(queries, chunks, 3, tile_bytes=t).select("query_id", "chunk_id").collect())) for t in (64, 1 << 20)]
    assert got[0] == got[1]


def test_a_query_travels_once_to_a_group_of_cells(spark):
    rows = _awkward_vectors()
    index = vi.build_index(_vectors(spark, "chunk_id", rows), cells=15)
    groups = vi._cell_groups(index, 250)
    held = {}
    for cell, group in groups.items():
        held[group] = held.get(group, 0) + index.entries[cell]
    assert set(groups) == set(index.entries) and 1 < len(held) < len(index.entries)
    assert all(n <= 250 or list(groups.values()).count(g) == 1 for g, n in held.items())
    cells = np.array(sorted(index.entries))
    asked = np.array([q for q in range(40)])
    import pandas as pd

    pdf = pd.DataFrame({"query_rep": asked + 100, "vector": [[0.0]] * 40})
    out = pd.concat(list(vi._probes(pdf, np.repeat(asked, len(cells)), np.tile(cells, 40), groups)))
    assert len(out) == 40 * len(held)
    assert all(sorted(c for x in part["cells"] for c in x) == cells.tolist() for _, part in out.groupby("query_rep"))
