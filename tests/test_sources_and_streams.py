import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wardenframe.operators.contracts import Contract
from wardenframe.operators.ingest import ingest_report
from wardenframe.operators.serving import latest_state
from wardenframe.session import scratch_path
from wardenframe.sources import json_arrays, landing, scans, sinks
from wardenframe.streaming import feeds
from wardenframe.streaming import sinks as stream_sinks


def test_csv_keeps_leading_zeros_and_blanks_are_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,code,note\n1,007,""\n2,NA,"a ""b"", c"\n')
    rows = [tuple(r) for r in scans.read_csv_text(spark, str(tmp_path)).orderBy("id").collect()]
    assert rows == [("1", "007", None), ("2", None, 'a "b", c')]


def test_json_documents_are_unwrapped(spark, tmp_path):
    docs = [{"records": [{"id": 1, "x": {"y": 2}}, {"id": 2}]}, {"items": [{"id": 3, "x": "t"}]}, {"id": 4, "z": True}]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    got = {r.id: (r.x, r.z) for r in scans.read_json_records(spark, str(tmp_path)).collect()}
    assert got == {"1": ('{"y":"2"}', None), "2": (None, None), "3": ("t", None), "4": (None, "true")} or got["1"][0] in ('{"y":2}', '{"y":"2"}')


def test_knowledge_folder(spark, tmp_path):
    (tmp_path / "rules" / "deep").mkdir(parents=True)
    (tmp_path / "rules" / "deep" / "a.md").write_text("# Title\nline two\n")
    (tmp_path / "top.txt").write_text(" text ")
    (tmp_path / "skip.bin").write_text("no")
    got = {(r.source, r.category) for r in scans.read_knowledge(spark, str(tmp_path)).collect()}
    assert got == {("a.md", "rules"), ("top.txt", "general")}


def test_append_is_repeatable(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "store"), ["k"])
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_append_refuses_a_misnamed_key_and_chooses_by_order(spark, tmp_path):
    store = str(tmp_path / "store")
    sinks.append_new(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string"), store, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(store).collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(AnalysisException):
        sinks.append_new(spark.createDataFrame([(1, "b")], "key int, v string"), store, ["key"])
    assert spark.read.parquet(store).count() == 2


def test_landing_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("claim_id,amount\n007,10\n008,NA\n")
    (tmp_path / "b.csv").write_text("amount,claim_id,extra\n20,009,x\n")
    (tmp_path / "c.json").write_text('{\n "records": [{"claim_id": "1"}, {"claim_id": "2"}]\n}')
    (tmp_path / "d.json").write_text('{"claim_id": "3"}\n{"data": [{"claim_id": "4", "amount": 5}]}\n')
    spark.createDataFrame([("5",)], "claim_id string").coalesce(1).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([("6", 7)], "claim_id string, y int").coalesce(1).write.parquet(str(tmp_path / "f"))
    landed = landing.read_landing(spark, str(tmp_path))
    got = {r.claim_id: (r.amount, r.extra, r.y, r.format) for r in landed.collect()}
    assert got == {
        "007": ("10", None, None, "csv"), "008": (None, None, None, "csv"), "009": ("20", "x", None, "csv"), "1": (None, None, None, "json"), "2": (None, None, None, "json"),
        "3": (None, None, None, "json"), "4": ("5", None, None, "json"), "5": (None, None, None, "parquet"), "6": (None, None, "7", "parquet"),
    }


def test_ingest_reports_each_file(spark, tmp_path):
    contract = Contract(
        name="small", required=("claim_id", "when", "amount"), types={"when": "date", "amount": "float"}, aliases={"claim_id": ("claim number",), "amount": ("billed",), "when": ("dos",)},
        conditional={}, allowed={}, non_negative=("amount",), unique=("claim_id",),
    )
    (tmp_path / "good.csv").write_text("Claim Number,dos,BILLED,note\n007,2024-01-02,5,x\n008,2024-02-01,6,y\n")
    (tmp_path / "bad.csv").write_text("when,claim_id,amount\n2024-13-01,1,5\n2024-01-01,2,-1\n2024-01-01,3,1\n2024-01-01,3,1\n2024-01-05,007,1\n")
    (tmp_path / "short.csv").write_text("claim_id,amount\n1,5\n")
    (tmp_path / "other.csv").write_text("page,visits\n1,5\n")
    report, tagged = ingest_report(landing.read_landing(spark, str(tmp_path)), [contract])
    got = {r.file.rsplit("/", 1)[1]: (r.rows, r.valid, r.invalid, r.missing_columns, r.unexpected_columns, r.status) for r in report.collect()}
    assert got == {"good.csv": (2, 2, 0, 0, 1, "PASS"), "bad.csv": (5, 1, 4, 0, 0, "FAIL"), "short.csv": (1, 1, 0, 1, 0, "FAIL"), "other.csv": (1, None, None, None, None, "UNMATCHED")}
    assert {r.claim_id for r in tagged["small"].where("file LIKE '%good%'").collect()} == {"007", "008"}


def test_rows_of_few_files_are_not_shuffled_to_meet_their_mapping(spark, tmp_path, monkeypatch):
    """What is known of few files goes to the rows; of many, both are shuffled, with the same outcome."""
    from wardenframe.operators import ingest

    contract = Contract(name="small", required=("claim_id", "amount"), types={"amount": "float"}, aliases={"amount": ("billed",)}, conditional={}, allowed={}, non_negative=("amount",), unique=())
    (tmp_path / "a.csv").write_text("claim_id,BILLED\n007,5\n008,-6\n")
    (tmp_path / "b.csv").write_text("amount,claim_id\nx,1\n")
    landed = landing.read_landing(spark, str(tmp_path))
    files = [r["file"] for r in landed.select("file").distinct().orderBy("file").collect()]
    resolved = spark.createDataFrame([(files[0], "small", "amount", "BILLED"), (files[1], "small", "amount", "amount")], "file_id string, schema string, canonical string, column_name string")
    monkeypatch.setattr(ingest, "FILES_SENT", 2)
    for known, shuffled in ((2, False), (3, True), (None, True)):
        renamed = ingest.rename_columns(landed, resolved, contract, known)
        plan = renamed._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" not in plan) == shuffled
        assert sorted((r.file, r.amount) for r in renamed.collect()) == [(files[0], "-6"), (files[0], "5"), (files[1], "x")]
    found = []
    for most in (2, 1):
        monkeypatch.setattr(ingest, "FILES_SENT", most)
        report, tagged = ingest_report(landed, [contract])
        found.append((sorted((r.claim_id, r.amount, len(r.errors)) for r in tagged["small"].collect()), sorted((r.rows, r.valid, r.invalid, r.status) for r in report.collect())))
    assert found[0] == found[1] == ([("007", "5", 0), ("008", "-6", 1), ("1", "x", 1)], [(1, 0, 1, "FAIL"), (2, 1, 1, "FAIL")])


def test_more_claims_are_landed_in_more_parts(spark, tmp_path, monkeypatch):
    import glob

    from wardenframe.plans import files

    spark.range(300).selectExpr(
        "id div 4 + 1 AS l_orderkey", "id % 37 AS l_partkey", "id % 5 AS l_suppkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber", "id * 1.5D AS l_extendedprice",
        "CASE id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'R' ELSE 'A' END AS l_returnflag", "TIMESTAMP '1997-01-01' AS l_shipdate",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(7).selectExpr("id AS event_id", "id * 2.5D AS value").write.parquet(str(tmp_path / "events.parquet"))
    folders, found = [], []
    monkeypatch.setattr(files, "scratch_path", lambda s, label, keep=files.scratch_path: folders.append(keep(s, label)) or folders[-1])
    for rows in (files.CLAIMS_PER_PART, 60):
        monkeypatch.setattr(files, "CLAIMS_PER_PART", rows)
        found.append({r["shape"]: (r["rows"], r["valid"], r["invalid"], r["status"]) for r in files.landing_ingest(spark, str(tmp_path)).collect()})
    assert found[0] == found[1] and sum(r[0] for k, r in found[0].items() if k != "other") == 300 and found[0]["other"][0] == 7
    assert [len(glob.glob(f"{f}/reordered/part-*")) for f in folders] == [3, 5]


def test_landing_cells_of_awkward_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"a,b",c,c,\n"x, ""y""",007,2,z\n1\n,,,\n')
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "n.csv").write_text("Claim,amount\n5,6\n")
    (tmp_path / "l.json").write_text('{"id": "1", "x": {"y": [1, 2]}}\n\n{"records": [{"id": "2"}, {"id": "3", "z": null}]}\n{"items": []}\n{"data": "text", "id": 4}\n')
    (tmp_path / "w.json").write_text('[\n {"id": "5"},\n {"id": "6"}\n]\n')
    found = {}
    for r in landing.read_landing_cells(spark, str(tmp_path)).collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(dict(sorted(r.cells.items())))
    assert sorted(found["q.csv"], key=str) == sorted([{"_c3": "z", "a,b": 'x, "y"', "c1": "007", "c2": "2"}, {"_c3": None, "a,b": "1", "c1": None, "c2": None}, {"_c3": None, "a,b": None, "c1": None, "c2": None}], key=str)
    assert found["n.csv"] == [{"Claim": "5", "amount": "6"}]
    assert sorted(found["l.json"], key=lambda c: c["id"]) == [{"id": "1", "x": '{"y":[1,2]}'}, {"id": "2"}, {"id": "3", "z": None}, {"data": "text", "id": "4"}]
    assert sorted(c["id"] for c in found["w.json"]) == ["5", "6"]
    columns = {}
    for r in landing.cell_columns(landing.read_landing_cells(spark, str(tmp_path))).collect():
        columns.setdefault(r.file_id.rsplit("/", 1)[1], []).append((r.pos, r.column_name))
    assert columns["q.csv"] == [(0, "a,b"), (1, "c1"), (2, "c2"), (3, "_c3")] and columns["l.json"] == [(0, "data"), (1, "id"), (2, "x")]
    (tmp_path / "long.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells than its header"):
        landing.read_landing_cells(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("split_bytes", [64, 700, 1 << 20])
def test_json_arrays_are_cut_by_byte_ranges(spark, tmp_path, split_bytes):
    import random

    rng = random.Random(split_bytes)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 4)
        if kind < 2:
            return "".join(rng.choice('ab{}[]",:\\é\n ') for _ in range(rng.randrange(12)))
        if kind < 4:
            return rng.choice([1, -2.5, None, True])
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(['k"', "x}", "[y", "z"]) + str(i): value(depth + 1) for i in range(rng.randrange(4))}

    def record(k):
        return {"id": k, "v": value()} | ({"long": "{" * 900} if k % 37 == 5 else {})

    want = {}
    for number, (indent, wrap) in enumerate([(None, None), (1, None), (None, "data"), (2, "records"), (None, "items"), (None, ""), (1, "")]):
        records = [record(k) for k in range(60)]
        doc = records if wrap is None else {"meta": {"deep": [{"a": [1]}]}, "other": [{"q": 1}], wrap: records, "after": [{"no": 1}], "text": 'x"]}'} if wrap else {"id": 7, "list": [1, 2], "inner": {"a": [{"b": 1}]}}
        if wrap == "data":
            doc = {"items": [{"worse": 1}]} | doc  # a key further down the list of keys, earlier in the file
        want[f"{number}.json"] = [json.dumps(r) for r in records] if wrap != "" else [json.dumps(doc)]
        (tmp_path / f"{number}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False) + ("\n" if number % 2 else ""))
    (tmp_path / "none.json").write_text('{"records": []}')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = {}
        for r in json_arrays.read_json_arrays(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.dumps(json.loads(r.record)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.pop("none.json") == ['{"records": []}']  # without a record in its lists, the document is one
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_landing_plan_does_not_grow_with_files(spark, tmp_path, capsys):
    def plan(folder, files):
        (tmp_path / folder).mkdir()
        for k in range(files):
            (tmp_path / folder / f"{k}.csv").write_text(f"id,h{k}\n{k},x\n")
            (tmp_path / folder / f"{k}.json").write_text(f'{{"id": {k}, "j{k}": 1}}\n' if k % 2 else f'{{\n"id": {k},\n "j{k}": 1}}\n')
        df = landing.read_landing_cells(spark, str(tmp_path / folder))
        assert df.count() == 2 * files
        df.explain("formatted")
        return len(__import__("re").sub(r"[0-9a-f-]{36}|Location:[^\n]*|#\d+L?|\d+", "", capsys.readouterr().out))

    assert plan("few", 2) == plan("many", 40)
    assert landing.read_landing_cells(spark, str(tmp_path / "many")).where("format = 'csv'").select(F.map_keys("cells").alias("k")).distinct().count() == 40


def test_landing_of_nothing(spark, tmp_path):
    (tmp_path / "readme.md").write_text("no records")
    assert landing.read_landing_cells(spark, str(tmp_path)).collect() == []


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, default: None)
    for master, fine in (("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)):
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fine:
            assert scratch_path(fake, "x")
        else:
            with pytest.raises(RuntimeError):
                scratch_path(fake, "x")


def _write(spark, folder, name, rows):
    schema = "at timestamp, kind string"
    spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), k) for m, k in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_late_rows_are_dropped_from_closed_windows(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = spark.createDataFrame([], "at timestamp, kind string").schema

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        feeds.drain(feeds.windowed_trend(stream, "at", "kind", "10 minutes", lateness="10 minutes"), "t", output=out, checkpoint=state)

    _write(spark, folder, "a", [(1, "x"), (2, "x"), (60, "x")])
    run()
    _write(spark, folder, "b", [(3, "x"), (61, "x"), (200, "x")])
    run()
    got = {(r.period_start.hour, r.period_start.minute): r.anomalies for r in spark.read.parquet(out).collect()}
    assert got == {(0, 0): 2, (1, 0): 2}


def test_state_stream_continues_over_restarts(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "record_id string, status string, severity string, id string, at timestamp"

    def at(h):
        return dt.datetime(2024, 1, 1, h)

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("recursiveFileLookup", True).parquet(folder)
        feeds.drain(feeds.current_state(stream), "s", output=out, checkpoint=state)

    run("a", [("r1", "OPEN", "LOW", "1", at(1)), ("r1", "RESOLVED", "LOW", "2", at(5)), ("r2", "OPEN", "HIGH", "3", at(2))])
    run("b", [("r1", "IGNORED", "LOW", "4", at(3)), ("r2", "RESOLVED", "HIGH", "5", at(4))])
    moves = spark.read.parquet(out)
    assert moves.count() == 3  # the late change of r1 moves nothing
    now = {r.record_id: r.status for r in latest_state(moves, "record_id", "at", "id").collect()}
    assert now == {"r1": "RESOLVED", "r2": "RESOLVED"}
    assert moves.where(F.col("record_id") == "r2").count() == 2


@pytest.mark.parametrize("event_time", ["at", None])
def test_repeated_claims_are_kept_as_invalid(spark, tmp_path, event_time):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "claim_id string, n long, at timestamp"
    contract = Contract(name="small", required=("claim_id",), types={}, aliases={}, conditional={}, allowed={}, non_negative=(), unique=("claim_id",))

    def day(d):
        return dt.datetime(2024, 1, d)

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("recursiveFileLookup", True).parquet(folder)
        feeds.drain(feeds.quarantine(stream, contract, event_time), "q", ("outcome",), output=out, checkpoint=state)

    run("a", [("a", 1, day(9)), ("a", 2, day(9)), ("b", 3, day(9)), ("c", 4, None), (None, 5, day(9)), (None, 6, day(9))])
    run("b", [("a", 7, day(9)), ("b", 8, day(1)), ("b", 9, day(10)), ("c", 10, day(9)), ("d", 11, day(1)), (None, 12, day(9))])
    found = spark.read.parquet(out).collect()
    repeated = {1, 2, 7, 9} if event_time else {1, 2, 7, 8, 9, 10}
    missing = {5, 6, 12}
    assert sorted((r.n, r.outcome) for r in found) == [(n, "invalid" if n in repeated | missing else "valid") for n in range(1, 13)]
    assert {(r.n, e.type) for r in found for e in r.errors} == {(n, "duplicate") for n in repeated} | {(n, "completeness") for n in missing}


SMALL = Contract(name="small", required=("claim_id",), types={}, aliases={}, conditional={}, allowed={}, non_negative=(), unique=("claim_id",))


def _day(d, month=1):
    return dt.datetime(2024, month, d)


def _land(spark, folder, name, rows):
    spark.createDataFrame(rows, "claim_id string, n long, at timestamp").coalesce(1).write.parquet(f"{folder}/{name}")


def _claims(spark, folder, files_per_batch=None):
    reader = spark.readStream.schema("claim_id string, n long, at timestamp").option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


class _StateWatch:
    """State rows and dropped rows of the progress reports of all streams that ran."""

    def __init__(self, spark):
        from pyspark.sql.streaming import StreamingQueryListener

        seen = self.seen = []

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event): ...
            def onQueryIdle(self, event): ...
            def onQueryTerminated(self, event): ...

            def onQueryProgress(self, event):
                seen.extend((s.numRowsTotal, s.numRowsDroppedByWatermark) for s in event.progress.stateOperators)

        self.spark, self.listener = spark, Listener()
        spark.streams.addListener(self.listener)

    def stop(self):
        import time

        time.sleep(2)
        self.spark.streams.removeListener(self.listener)
        return self.seen


def test_repeat_state_ends_and_late_rows_are_kept(spark, tmp_path):
    folder, root, state = str(tmp_path / "in"), str(tmp_path / "sinks"), str(tmp_path / "state")
    watch = _StateWatch(spark)

    def run():
        stream = feeds.quarantine(_claims(spark, folder), SMALL, "at", horizon="1 day", lateness="2 days")
        stream_sinks.drain_to_sinks(stream, root, state)

    # Fifty keys a day for some days, one of them every hour; then a quiet key, long after.
    for d in (1, 2, 3, 20):
        _land(spark, folder, f"d{d}", [(f"k{d}-{k}", 1000 * d + k, _day(d)) for k in range(50)] + [("hot", 10**6 + 100 * d + h, _day(d) + dt.timedelta(hours=h)) for h in range(24)])
        run()
    _land(spark, folder, "later", [("k20-1", 1, _day(21)), ("k1-1", 2, _day(2)), ("fresh", 3, _day(18)), ("fresh", 4, _day(1)), (None, 5, _day(1))])
    run()
    found = {r.n: (r.outcome, sorted(e.type for e in r.errors)) for r in stream_sinks.committed_rows(spark, root).collect()}
    assert len(found) == 4 * 74 + 5  # every row is kept, late ones too
    assert found[1] == ("invalid", ["duplicate"])  # the copy of the day before is still known
    assert found[2] == ("invalid", ["late"])  # its copy may be forgotten, and is
    assert found[3] == ("valid", [])  # behind the watermark, but not by more than it can be compared over
    assert found[4] == ("invalid", ["late"])
    assert found[5] == ("invalid", ["completeness"])
    assert all(found[10**6 + 100 * d + h][0] == "invalid" for d in (1, 2, 3, 20) for h in range(24))
    seen = watch.stop()
    assert all(dropped == 0 for _, dropped in seen)
    # Keys of the first days are gone after the 20th: at most those of that day, the hot one and the fresh one, with their timers.
    assert seen[-1][0] <= 60 * 3, seen
    assert max(total for total, _ in seen) >= 150


def test_state_of_a_key_does_not_grow_with_its_rows():
    import numpy as np
    import pandas as pd

    class Cells(dict):
        def iterator(self):
            return iter([(k, v) for k, v in self.items()])

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

    class Handle:
        timers = []

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        mark = 0

        def getCurrentWatermarkInMs(self):
            return self.mark

    rng = np.random.default_rng(5)
    processor = feeds.MarkRepeats(100.0, ["n", "_key", "_at"], True)
    processor.cells, processor.handle, times = Cells(), Handle(), Times()
    known = []
    for batch in range(60):
        at = np.round(rng.choice([rng.uniform(0, 2000, 3), rng.uniform(50 * batch, 50 * batch + 400, 3)]), 1) if batch % 3 else np.round(rng.uniform(50 * batch, 50 * batch + 30, 40), 1)
        oldest = times.mark / 1e3 - 100 if times.mark else -np.inf
        out = next(processor.handleInputRows(("+k",), iter([pd.DataFrame({"n": range(len(at)), "_key": "+k", "_at": at})]), times))
        want = [any(abs(x - y) <= 100 for y in known) or any(abs(x - y) <= 100 for j, y in enumerate(at) if j != i) for i, x in enumerate(at)]
        late = at < oldest
        assert (out["_late"].to_numpy() == late).all()
        assert (out["_repeat"].to_numpy() == np.array(want))[~late].all()
        known += at[~late].tolist()
        times.mark = max(times.mark, int((max(known) - 300) * 1000))
        assert len(processor.cells) <= (300 + 2 * 100) / 100 + 20


def test_keys_of_a_group_are_told_apart():
    """Many keys in one group: each is compared with its own times only, over batches, parts that become one, and timers."""
    import numpy as np
    import pandas as pd

    class Cells(dict):
        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

    class Handle:
        at = None

        def registerTimer(self, at):
            assert self.at is None  # a group has one timer
            self.at = at

    class Times:
        mark = 0

        def getCurrentWatermarkInMs(self):
            return self.mark

    rng = np.random.default_rng(8)
    processor = feeds.MarkRepeats(100.0, ["n", "_key", "_at", "_group"], True)
    processor.cells, processor.handle, times = Cells(), Handle(), Times()
    known = []
    for batch in range(50):
        keys = rng.choice(["+a", "+é", "+", "-a", *[f"+k{i}" for i in range(60)]], 30)
        at = np.round(rng.uniform(40 * batch, 40 * batch + 500, 30), 1)
        at[rng.random(30) < 0.1] = np.nan
        oldest = times.mark / 1e3 - 100 if times.mark else -np.inf
        frame = pd.DataFrame({"n": range(30), "_key": keys, "_at": at, "_group": "7"})
        out = next(processor.handleInputRows(("7",), iter([frame[:11], frame[11:]]), times))
        rows = list(zip(keys, at))

        def near(i):
            key, x = rows[i]
            others = [y for j, (k, y) in enumerate(rows) if j != i and k == key]
            if key.startswith("-") or np.isnan(x):
                return not key.startswith("-") and any(np.isnan(y) for y in others)
            return any(abs(x - y) <= 100 for y in others + [y for k, y in known if k == key])

        late = np.array([k.startswith("+") and x < oldest for k, x in rows])
        assert (out["_late"].to_numpy() == late).all()
        assert (out["_repeat"].to_numpy() == [near(i) for i in range(30)])[~late].all()
        known += [(k, x) for (k, x), old in zip(rows, late) if not old and x == x and k.startswith("+")]
        times.mark = max(times.mark, int((max(x for _, x in known) - 600) * 1000))
        if processor.handle.at is not None and processor.handle.at <= times.mark:
            processor.handle.at = None
            list(processor.handleExpiredTimer(("7",), times, None))
        assert len(processor.cells) <= feeds.PARTS
        held = feeds._Cells.joined([feeds._Cells.unpack(v[0]) for v in processor.cells.values()]).merged()
        alive = {(k, x // 100) for k, x in known if x >= times.mark / 1e3 - 200}
        assert set(zip(held.keys, held.cells)) >= alive and len(held) <= 4 * len(alive) + 60
    times.mark = 10**7
    list(processor.handleExpiredTimer(("7",), times, None))
    assert not processor.cells


@pytest.mark.parametrize("step", ["after_rows", "after_ledger"])
def test_a_torn_batch_is_written_once(spark, tmp_path, step):
    """The stream dies in mid-batch, between the sinks or before it notes the batch as done, and is started again."""
    folder, root, state = str(tmp_path / "in"), str(tmp_path / "sinks"), str(tmp_path / "state")
    _land(spark, folder, "a", [("a", 1, _day(1)), ("b", 2, _day(1))])
    _land(spark, folder, "b", [("a", 3, _day(1)), (None, 4, _day(1))])
    _land(spark, folder, "c", [("c", 5, _day(2))])
    died = []

    def die(number):
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("lost in mid-batch")

    def tagged():
        return feeds.quarantine(_claims(spark, folder, files_per_batch=1), SMALL, "at")

    with pytest.raises(Exception, match="lost in mid-batch"):
        stream_sinks.drain_to_sinks(tagged(), root, state, **{step: die})
    before = {r.batch_id for r in stream_sinks.committed_rows(spark, root).collect()}
    assert before == ({0} if step == "after_rows" else {0, 1})  # a batch is seen in all sinks or in none
    assert {r.batch_id for r in stream_sinks.committed_issues(spark, root).collect()} <= before
    stream_sinks.drain_to_sinks(tagged(), root, state)
    stream_sinks.drain_to_sinks(tagged(), root, state)  # nothing new
    rows = stream_sinks.committed_rows(spark, root).collect()
    assert sorted(r.n for r in rows) == [1, 2, 3, 4, 5]
    repeats = {r.n for r in rows if any(e.type == "duplicate" for e in r.errors)}
    assert len(repeats) == 1 and repeats <= {1, 3}  # whichever came second
    ledger = {r.batch_id: (r.rows, r.valid, r.invalid) for r in stream_sinks.read_ledger(spark, root).collect()}
    assert len(ledger) == 3 and [sum(x) for x in zip(*ledger.values())] == [5, 3, 2]
    issues = [(r.type, r.rows) for r in stream_sinks.committed_issues(spark, root).collect()]
    assert sorted(issues) == [("completeness", 1), ("duplicate", 1)]
    with pytest.raises(ValueError, match="holds the batches of the stream"):
        stream_sinks.drain_to_sinks(tagged(), root, str(tmp_path / "another"))


def test_sinks_that_are_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stream_sinks.committed_rows(spark, str(tmp_path / "none"))
    assert stream_sinks.read_ledger(spark, str(tmp_path / "none")).collect() == []


def test_one_document_from_records_that_pass(spark, tmp_path):
    import json

    from wardenframe.plans.files import _as_document

    for n in (0, 1, 25):
        rows = spark.range(0, n, 1, 5).selectExpr("to_json(struct(id)) AS value")
        rows.coalesce(1).mapInArrow(_as_document('{"records": [', "]}"), "value string").write.text(f"{tmp_path}/{n}")
        text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/{n}").collect())
        assert sorted(r["id"] for r in json.loads(text)["records"]) == list(range(n))


def test_array_scan_sorts_few_rows(spark, tmp_path):
    """Pieces of a split are joined and sorted as few rows; each was one row."""
    import pyarrow as pa

    from wardenframe.sources import json_arrays as ja

    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 5 + ["g"]), pa.array([0, 0, 0, 9, 9, 9]), pa.array(range(6)), pa.array(["a", "", "é", "c", "d", "e"])], ["file", "block", "at", "value"])
    out = [r for b in ja._packed(iter([batch])) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in out] == [("f", 0, 0, "a}}é".encode()), ("f", 9, 3, b"c}d"), ("g", 9, 5, b"e")]
