import difflib
import random

import pytest

from wardenframe.operators import contracts as ct


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_force(columns, contract, threshold, similarity):
    """One column after the other, as a person would do it by hand."""
    vocab = {k: c for s, k, c in ct.vocabulary([contract])}
    mapping, taken, rest = {}, set(), []
    for pos, name in enumerate(columns):
        c = vocab.get(ct._plain(name))
        if c and c not in taken:
            mapping[pos] = c
            taken.add(c)
        else:
            rest.append((pos, ct._plain(name)))
    for pos, norm in rest:
        offers = [(similarity(norm, k), k) for k, c in vocab.items() if c not in taken and norm]
        offers = [o for o in offers if o[0] >= threshold]
        if offers:
            mapping[pos] = vocab[max(offers)[1]]
            taken.add(mapping[pos])
    return mapping


SIMILARITY = {
    "edit": lambda a, b: 1 - levenshtein(a, b) / max(len(a), len(b)),
    "sequence": lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(),
}


@pytest.mark.parametrize("kind", ["edit", "sequence"])
def test_resolution_equals_one_by_one_search(spark, kind):
    rng = random.Random(5)
    known = [k for _, k, _ in ct.vocabulary([ct.CLAIMS])]
    files = {}
    for f in range(60):
        names = []
        for k in rng.sample(known, 14):
            k = list(k)
            for _ in range(rng.choice((0, 1, 1, 2))):
                k[rng.randrange(len(k))] = rng.choice("abcdeimnot_")
            names.append("".join(k))
        # Near-copies of one name fight for the same and for neighbouring canonicals.
        names += [f"claim_{x}" for x in rng.sample(["dat", "dats", "amoun", "statu", "is", "ix", "dates"], 4)]
        rng.shuffle(names)
        files[f"f{f}"] = names
    rows = [(f, p, n) for f, names in files.items() for p, n in enumerate(names)]
    catalogue = spark.createDataFrame(rows, "file_id string, pos int, column_name string")
    for threshold in (0.82, 0.6):
        got = {}
        for r in ct.resolve_columns(catalogue, [ct.CLAIMS], threshold, kind).collect():
            got.setdefault(r.file_id, {})[r.pos] = r.canonical
        for f, names in files.items():
            assert got.get(f, {}) == brute_force(names, ct.CLAIMS, threshold, SIMILARITY[kind]), (f, names)


def test_name_normalisation(spark):
    from pyspark.sql import functions as F

    names = ["Claim ID", "claim-id", " CLAIM__ID ", "claim#id", "_x_", "Ünit no."]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ct.normalise_name(F.col("n"))).collect()]
    assert got == [ct._plain(n) for n in names] == ["claim_id", "claim_id", "claim_id", "claimid", "x", "nit_no"]


def test_detection_needs_enough_matches(spark):
    rows = [("a", p, c) for p, c in enumerate(ct.PHARMACY.required)] + [("b", p, c) for p, c in enumerate(("npi", "foo", "bar"))]
    catalogue = spark.createDataFrame(rows, "file_id string, pos int, column_name string")
    scores = ct.score_contracts(catalogue, ct.resolve_columns(catalogue, [ct.CLAIMS, ct.PHARMACY]), [ct.CLAIMS, ct.PHARMACY])
    assert {r.file_id: r.matched_schema for r in ct.detect_contract(scores).collect()} == {"a": "pharmacy", "b": None}


def test_read_contracts(tmp_path):
    (tmp_path / "labs_schema.json").write_text('{"required_columns": ["a"], "column_aliases": {"a": ["b"]}}')
    assert ct.vocabulary(ct.read_contracts(str(tmp_path)).values()) == [("labs", "a", "a"), ("labs", "b", "a")]


def test_pairs_that_cannot_match_are_left_out_before_python(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = ["claim", "member", "provider", "date", "amount", "id", "number", "status", "code", "total", "npi", "supply"]
    names = ["_".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)] + ["", "a", "x9", "claim_idd", "provder_id"]
    pairs = [(a, b) for a in names for b in names[:40]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"ca": ct._character_counts(F.col("a")), "cb": ct._character_counts(F.col("b"))})
    left = {(r.a, r.b) for r in df.where(ct.could_match(F.col("a"), F.col("ca"), F.col("b"), F.col("cb"), 0.82)).collect()}
    similar = {(a, b) for a, b in pairs if difflib.SequenceMatcher(None, a, b).ratio() >= 0.82}
    assert similar <= left and len(left) < len(set(pairs)) / 4


def test_tasks_of_the_resolution_follow_its_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(f"f{f}", p, n) for f in range(400) for p, n in enumerate(("claim_id", "npi", "Claim Date", "amount", "other"))]
    rows += [("f0", 5, None), (None, 0, "claim_id")]
    catalogue = spark.createDataFrame(rows, "file_id string, pos int, column_name string")
    whole = ct.resolve_columns(catalogue, [ct.CLAIMS])
    monkeypatch.setattr(ct, "PROPOSALS_PER_TASK", 100)
    spread = ct.resolve_columns(catalogue, [ct.CLAIMS])
    # 1601 proposals, repeated words that compress well.
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and sum(sizes) == 1601 and max(sizes) < 400
    assert sorted(map(str, spread.collect())) == sorted(map(str, whole.collect()))


def test_headers_of_many_orders_are_made_by_many_tasks(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F
    from wardenframe.plans import headers

    spark.range(500).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    whole = headers.landed(spark, str(tmp_path))
    monkeypatch.setattr(headers, "ORDERS_PER_TASK", 50)
    spread = headers.landed(spark, str(tmp_path))
    assert spread.select(F.spark_partition_id().alias("p")).distinct().count() == 10
    assert sorted(map(str, spread.collect())) == sorted(map(str, whole.collect()))
