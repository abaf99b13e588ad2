"""Stores: pages in order, records by key, profiles by part, verified sinks."""

import datetime as dt
import glob
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardenframe.operators import paging as pg
from wardenframe.operators import profile_store as st
from wardenframe.operators import serving as sv
from wardenframe.sources import keyed_store, sinks


def _events(spark, count, seed=1):
    rng = random.Random(seed)
    rows = [(f"{k:05d}", None if k % 50 == 7 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(count // 5)), k) for k in range(count)]
    return spark.createDataFrame(rows, "id string, detected_at timestamp, n long")


@pytest.mark.parametrize("ranges", [1, 7])
def test_pages_equal_offset(spark, tmp_path, ranges):
    df = _events(spark, 403)
    path = str(tmp_path / "pages")
    pg.write_pages(df, path, ranges=ranges)
    assert pg.total_rows(spark, path) == 403
    whole = [r.id for r in df.orderBy(F.desc("detected_at"), F.desc("id")).collect()]
    for size, numbers in ((20, (1, 2, 11, 20, 21, 22)), (400, (1, 2)), (1, (1, 403))):
        for number in numbers:
            assert [r.id for r in pg.read_page(spark, path, number, size).collect()] == whole[(number - 1) * size: number * size]
            assert [r.id for r in sv.page(df, number, size).collect()] == whole[(number - 1) * size: number * size]
    cursor, seen = None, [r for r in pg.read_page(spark, path, 1, 90).collect()]
    while True:
        cursor = (seen[-1].detected_at, seen[-1].id)
        more = pg.page_after(spark, path, cursor, 90).collect()
        if not more:
            break
        seen += more
    assert [r.id for r in seen] == whole


def test_a_page_reads_its_range_alone(spark, tmp_path, capsys):
    path = str(tmp_path / "pages")
    pg.write_pages(_events(spark, 1000), path, ranges=8)
    folders = sorted(glob.glob(f"{path}/rows/_range=*"))
    assert len(folders) > 3
    page = pg.read_page(spark, path, 3, 20)
    assert page.count() == 20
    page.explain("formatted")
    plan = capsys.readouterr().out
    assert "_range" in plan.split("PartitionFilters:")[1].splitlines()[0]


def test_keyed_store_equals_anti_join(spark, tmp_path):
    rng = random.Random(3)
    path, known = str(tmp_path / "store"), {}
    for batch in range(4):
        rows = [(rng.choice([f"r{rng.randrange(400)}", None]) if rng.random() < 0.05 else f"r{rng.randrange(400)}", rng.choice(["A", "B"]), batch * 1000 + k) for k in range(150)]
        df = spark.createDataFrame(rows, "record_id string, dataset string, n long")
        touched = keyed_store.append_by_bucket(df, path, ["record_id", "dataset"], order=["n"], buckets=8)
        assert touched == [] if batch == 0 else set(touched) <= set(range(8))
        for r, d, n in sorted(rows, key=lambda x: x[2]):
            if r is not None:
                known.setdefault((r, d), n)
        found = keyed_store.read_store(spark, path).where("record_id IS NOT NULL").collect()
        assert {(r.record_id, r.dataset): r.n for r in found} == known and len(found) == len(known)


def test_an_append_reads_only_buckets_that_may_hold_its_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    keyed_store.append_by_bucket(spark.range(5000).selectExpr("id AS k", "id AS v"), path, ["k"], buckets=32)
    other = keyed_store.append_by_bucket(spark.range(10**6, 10**6 + 500).selectExpr("id AS k", "id AS v"), path, ["k"], buckets=32)
    assert len(other) <= 2  # the filters let next to nothing pass
    same = keyed_store.append_by_bucket(spark.range(3).selectExpr("id AS k", "id AS v"), path, ["k"], buckets=32)
    assert 1 <= len(same) <= 3
    assert keyed_store.read_store(spark, path).count() == 5500


def test_profiles_roll_up_to_that_of_the_whole(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 20000
    frame = pd.DataFrame({
        "year": rng.integers(2020, 2024, n), "file": rng.choice(["a", "b", "c"], n), "x": np.round(rng.gamma(2.0, 50.0, n), 2), "y": rng.integers(-3, 4, n).astype(float),
        "kind": rng.choice(["red", "green", "blue", "rare"], n, p=[0.5, 0.3, 0.199, 0.001]),
    })
    frame.loc[rng.random(n) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(frame).withColumn("kind", F.when(F.col("y") != 3, F.col("kind")))
    path, parts = str(tmp_path / "profiles"), ["year", "file"]
    st.write_parts(st.sketch_parts(df.where("year < 2022"), parts, ["x", "y"], ["kind"]), path, parts)
    for _ in range(2):  # the second time replaces the first
        st.write_parts(st.sketch_parts(df.where("year >= 2021"), parts, ["x", "y"], ["kind"]), path, parts)
    store = st.read_parts(spark, path)
    assert store.count() == 4 * 3 * 3
    probs = {"q1": 0.25, "median": 0.5, "p99": 0.99}
    whole = {r.column_name: r for r in st.profile(st.roll_up(st.roll_up(store, ["year"])), probs).collect()}
    once = {r.column_name: r for r in st.profile(st.sketch_parts(df.withColumn("all", F.lit(1)), ["all"], ["x", "y"], ["kind"]), probs).collect()}
    x = frame.x.dropna().to_numpy()
    row = whole["x"]
    assert (row.rows, row.filled, row.missing) == (n, len(x), n - len(x)) and row.low == x.min() and row.high == x.max()
    assert math.isclose(row.mean, x.mean(), abs_tol=1e-6) and math.isclose(row.std, x.std(ddof=1), abs_tol=1e-6)
    for name, p in probs.items():
        for found in (row[name], once["x"][name]):
            assert (x < found).mean() <= p + st.RANK_ERROR and (x <= found).mean() >= p - st.RANK_ERROR
    exact = len(np.unique(x))
    assert abs(row.distinct_values - exact) <= exact * st.DISTINCT_ERROR and abs(once["x"].distinct_values - exact) <= exact * st.DISTINCT_ERROR
    assert whole["y"].distinct_values == 7 and (whole["y"].zeros, whole["y"].negatives) == (int((frame.y == 0).sum()), int((frame.y < 0).sum()))
    assert whole["kind"].mean is None and whole["kind"].q1 is None and whole["kind"].missing == int((frame.y == 3).sum())
    for column in ("rows", "filled", "zeros", "negatives", "low", "high", "mean", "std", "missing"):
        assert all(whole[c][column] == once[c][column] or math.isclose(whole[c][column], once[c][column], rel_tol=1e-9) for c in whole)
    top = {(r.rank, r.value, r.rows) for r in st.frequent_values(st.roll_up(store), 2).where("column_name = 'kind'").collect()}
    counts = frame.kind[frame.y != 3].value_counts()
    assert top == {(k + 1, v, int(c)) for k, (v, c) in enumerate(list(counts.items())[:2])}


def test_a_torn_document_sink_raises(spark, tmp_path):
    path = str(tmp_path / "documents")
    df = spark.range(1000).repartition(4).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE named_struct('x', id) END AS inner", "id % 2 = 0 AS anomaly_detected")
    assert sinks.write_documents(df, path)["records"] == 1000
    sinks.verify_documents(spark, path)
    back = spark.read.json(path)
    assert back.count() == 1000 and back.where("inner IS NULL").count() == 334 and "inner" in back.columns
    part = sorted(glob.glob(f"{path}/part-*"))[0]
    text = open(part).read()
    os.remove(part)
    with pytest.raises(sinks.TornSinkError):
        sinks.verify_documents(spark, path)
    with open(part, "w") as file:
        file.write(text.replace("1", "2"))
    crc = os.path.join(path, f".{os.path.basename(part)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(sinks.TornSinkError):
        sinks.verify_documents(spark, path)
    assert sinks.write_anomalies(df, str(tmp_path / "anomalies"))["records"] == 500


def test_a_compressed_document_sink_holds_what_was_written(spark, tmp_path):
    path = str(tmp_path / "anomalies")
    df = spark.range(1000).repartition(2).selectExpr("id", "repeat('the same text ', 20) AS text", "id % 2 = 0 AS anomaly_detected")
    assert sinks.write_anomalies(df, path, compression="gzip")["records"] == 500
    parts = sorted(glob.glob(f"{path}/part-*"))
    assert parts and sum(os.path.getsize(p) for p in parts) < 500 * 280 / 5
    assert {(r.id, r.text) for r in spark.read.json(path).collect()} == {(i, "the same text " * 20) for i in range(0, 1000, 2)}
    os.remove(parts[0])
    with pytest.raises(sinks.TornSinkError):
        sinks.verify_documents(spark, path)


def test_prescriber_documents_rule_the_table_once(spark, tmp_path):
    """The count before the risk and the documents read rows that were written."""
    from wardenframe.plans import knowledge

    spark.range(60).selectExpr(
        "id % 20 AS l_orderkey", "id % 6 AS l_partkey", "id % 4 AS l_suppkey", "CAST(id % 50 AS DOUBLE) AS l_quantity", "id * 1000.0D AS l_extendedprice",
        "CAST(make_date(1996 + CAST(id % 4 AS INT), 1, 1) AS TIMESTAMP) AS l_shipdate",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(20).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(6).selectExpr("id AS p_partkey", "concat('B', id % 3) AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    docs = knowledge.prescriber_documents(spark, str(tmp_path))
    assert docs.count() > 0 and docs.inputFiles() and all("prescriber-fused" in f for f in docs.inputFiles())
