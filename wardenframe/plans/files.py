"""Write-and-read-back queries of scans and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from wardenframe.operators import validation as va
from wardenframe.operators.contracts import CLAIMS, PHARMACY
from wardenframe.operators.ingest import ingest_report
from wardenframe.plans import pharmacy as pp
from wardenframe.plans import prescriber as pr
from wardenframe.plans import views
from wardenframe.plans.knowledge import prescriber_documents
from wardenframe.plans.registry import query
from wardenframe.plans.validation import _ISSUES, CONTRACT, TAGGED_SQL, tagged
from wardenframe.operators.records import pharmacy_document
from wardenframe.session import materialise, scratch_path
from wardenframe.sources import keyed_store, landing, scans, sinks
from wardenframe.sources.json_arrays import read_json_arrays
from wardenframe.sources.tables import read_table


@query(
    "csv_text_scan", "A1",
    views.with_views("claims_raw") + " SELECT claim_id, member_id, provider_id, claim_date, claim_amount, claim_status, nullif(denial_code, '') AS denial_code FROM claims_raw",
)
def csv_text_scan(spark, sf_dir):
    path = scratch_path(spark, "claims-csv")
    sinks.write_csv(views.claims_raw(spark, sf_dir), path)
    return scans.read_csv_text(spark, path)


@query(
    "json_wrapped_scan", "A2",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, o_orderstatus AS status FROM orders",
)
def json_wrapped_scan(spark, sf_dir):
    """Each order is one document whose record sits under a varying wrapper key, or under none."""
    orders = read_table(spark, sf_dir, "orders")
    record = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), F.col("o_orderstatus").alias("status")
    )
    keys = [*scans.WRAPPER_KEYS, None]
    docs = [F.to_json(F.struct(F.array(record).alias(k))) if k else F.to_json(record) for k in keys]
    text = F.element_at(F.array(*docs), (F.col("o_orderkey") % len(keys) + 1).cast("int"))
    path = scratch_path(spark, "orders-json")
    orders.select(text.alias("value")).write.text(path)
    return scans.read_json_records(spark, path, multi_line=False).select("id", "amount", "status")


def _as_document(head: str, end: str):
    """Lines of one document from its records, as they pass: the head, the records with commas between them, the end."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = head
        for batch in batches:
            values = batch.column("value")
            if len(values):
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.array([before] + [","] * (len(values) - 1), values.type), values, pa.scalar("", values.type))], ["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array([end if before == "," else head + end], pa.string())], ["value"])
    return lines


@query(
    "json_array_scan", "A2",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('{\"name\":\"', o_orderstatus, ' ', repeat(chr(92), 3), '\"}]\"}') AS note, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders",
)
def json_array_scan(spark, sf_dir):
    """All orders in the list of one document, one file, read by its byte ranges; their texts hold quotes and brackets."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.struct(F.concat("o_orderstatus", F.lit(' \\"}]')).alias("name")).alias("note"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"))
    text = F.to_json(F.struct("id", "note", "amount"))
    path = scratch_path(spark, "orders-array")
    # One file is the point here: its lines are the document's head, the records and the document's end. Its one writer sorts nothing.
    head, end = '{"source": {"made": [{"by": 1}]}, "records": [', "]}"
    orders.select(text.alias("value")).coalesce(1).mapInArrow(_as_document(head, end), "value string").write.text(path)
    cells = F.from_json("record", "map<string,string>")
    return read_json_arrays(spark, path).select(cells.alias("c")).select(*[F.element_at("c", n).alias(n) for n in ("id", "note", "amount")])


@query("pruned_parquet_scan", "A3", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def pruned_parquet_scan(spark, sf_dir):
    """Two columns come out; the filter and the three columns it needs reach the scan."""
    lines = scans.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_returnflag"])
    return lines.where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_quantity")


@query("csv_inferred_scan", "A4", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_inferred_scan(spark, sf_dir):
    path = scratch_path(spark, "part-csv")
    sinks.write_csv(read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), path)
    return scans.read_csv_inferred(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_size").cast("long").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))


@query(
    "year_partitioned_table", "A6 A7",
    pp.BASE_SQL + " SELECT data_year, npi, brand, tot_clms, drug_cost_per_claim FROM ph_features WHERE data_year IN (1997, 1999)",
)
def year_partitioned_table(spark, sf_dir):
    """All years in one partitioned ZSTD table; the year list prunes folders."""
    path = scratch_path(spark, "pharmacy-years")
    sinks.write_by_year(pp.features(spark, sf_dir), path)
    return scans.read_years(spark, path, [1997, 1999]).select("data_year", "npi", "brand", "tot_clms", "drug_cost_per_claim")


@query(
    "validation_sinks", "A8",
    TAGGED_SQL + f', issues AS ({_ISSUES}) SELECT \'valid\' AS part, NULL AS type, NULL AS "column", count(*) AS rows FROM tagged WHERE NOT bad UNION ALL SELECT \'invalid\', NULL, NULL, count(*) FROM tagged WHERE bad '
    'UNION ALL SELECT \'report\', type, "column", count(*) FROM issues GROUP BY ALL',
)
def validation_sinks(spark, sf_dir):
    valid, invalid, report = sinks.write_validated(tagged(spark, sf_dir), CONTRACT, scratch_path(spark, "claims-validated"))
    none = F.lit(None).cast("string")

    def count(df, part):
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(part).alias("part"), none.alias("type"), none.alias("column"), "rows")

    found = report.groupBy(F.lit("report").alias("part"), "type", "column").agg(F.sum("rows").alias("rows"))
    return count(valid, "valid").unionByName(count(invalid, "invalid")).unionByName(found)


@query(
    "landing_folder_report", "A9",
    TAGGED_SQL + ", f AS (SELECT *, CASE claim_status WHEN 'PAID' THEN 'csv' WHEN 'DENIED' THEN 'json' ELSE 'parquet' END AS format FROM tagged) "
    "SELECT format, count(*) AS rows, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS invalid FROM f GROUP BY format",
)
def landing_folder_report(spark, sf_dir):
    """Files of three formats in one folder, read together and reported per format."""
    claims = views.claims_raw(spark, sf_dir)
    folder = scratch_path(spark, "landing")
    sinks.write_csv(claims.where("claim_status = 'PAID'"), f"{folder}/a")
    claims.where("claim_status = 'DENIED'").write.option("ignoreNullFields", False).json(f"{folder}/b")
    claims.where("claim_status NOT IN ('PAID', 'DENIED')").write.parquet(f"{folder}/c")
    landed = landing.read_landing(spark, folder)
    return va.tag_errors(landed, CONTRACT).groupBy("format").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid")
    )


_SHAPES = "CASE WHEN claim_status = 'PAID' THEN 'aliases' WHEN claim_status = 'DENIED' THEN 'wrapped' WHEN claim_status = 'PENDING' THEN 'reordered' ELSE 'plain' END"
#: Claims for each of which every kind of file gets one more part, beyond three: writers of a few parts would sort whole tables.
CLAIMS_PER_PART = 1_000_000
_INGESTED = ("claim_id", "member_id", "provider_id", "claim_date", "claim_amount", "claim_status", "denial_code")


@query(
    "landing_ingest", "A9 B2 B4 C1 C9",
    TAGGED_SQL.replace("PARTITION BY claim_id", f"PARTITION BY claim_id, {_SHAPES}") + f", f AS (SELECT {_SHAPES} AS shape, bad FROM tagged), "
    "g AS (SELECT shape, count(*) AS rows, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS invalid FROM f GROUP BY shape) "
    "SELECT shape, 'claims' AS matched_schema, CASE WHEN shape = 'plain' THEN 'parquet' WHEN shape = 'wrapped' THEN 'json' ELSE 'csv' END AS format, rows, valid, invalid, "
    "4 AS missing_columns, CASE shape WHEN 'aliases' THEN 2 ELSE 0 END AS unexpected_columns, 'FAIL' AS status FROM g "
    "UNION ALL SELECT 'other', NULL, 'csv', count(*), NULL, NULL, NULL, NULL, 'UNMATCHED' FROM events",
)
def landing_ingest(spark, sf_dir):
    """Files that differ in kind, column order, spelling, extra columns and wrapping, each with its own outcome.

    A kind of file is written by key, so that copies of a key are in one file, and summed up for the comparison.
    """
    files = max(3, -(-read_table(spark, sf_dir, "lineitem").count() // CLAIMS_PER_PART))
    claims = views.claims_raw(spark, sf_dir).select(*_INGESTED).withColumn("shape", F.expr(_SHAPES))
    folder = scratch_path(spark, "ingest")

    def part(name):
        return claims.where(F.col("shape") == name).drop("shape").repartition(files, "claim_id")

    aliases = {"claim_id": "Claim Number", "member_id": "patient_id", "provider_id": "NPI", "claim_date": "dos", "claim_amount": "Billed-Amount", "claim_status": "status", "denial_code": "denial_reason"}
    sinks.write_csv(part("aliases").select(F.lit("x").alias("note"), *[F.col(c).alias(a) for c, a in aliases.items()], F.lit("y").alias("batch")), f"{folder}/aliases")
    sinks.write_csv(part("reordered").select(*reversed(_INGESTED)), f"{folder}/reordered")
    part("plain").write.parquet(f"{folder}/plain")
    wrapped = part("wrapped").groupBy("claim_id").agg(F.collect_list(F.struct(*_INGESTED)).alias("records")).drop("claim_id")
    wrapped.write.option("ignoreNullFields", False).json(f"{folder}/wrapped")
    sinks.write_csv(read_table(spark, sf_dir, "events").select("event_id", F.col("value").alias("bounce"), F.lit("fr").alias("country")), f"{folder}/other")
    report, _ = ingest_report(materialise(landing.read_landing_cells(spark, folder), "landed"), (CLAIMS, PHARMACY), similarity="edit")
    shape = F.element_at(F.split("file", "/"), -2).alias("shape")
    same = ("matched_schema", "format", "missing_columns", "unexpected_columns")
    return report.groupBy(shape, *same).agg(F.sum("rows").alias("rows"), F.sum("valid").alias("valid"), F.sum("invalid").alias("invalid"), F.min("status").alias("status"))


@query(
    "pharmacy_json_sink", "A10",
    pp.FULL_SQL + " SELECT CAST(npi AS VARCHAR) AS record_id, brand, CAST(data_year AS BIGINT) AS data_year, final_severity, sla_status AS status FROM ph_sla WHERE final_anomaly OR sla_status IN ('MAYBE', 'NO')",
)
def pharmacy_json_sink(spark, sf_dir):
    path = scratch_path(spark, "pharmacy-json")
    sinks.write_documents(pharmacy_document(pp.with_sla(spark, sf_dir).where(F.col("final_anomaly") | F.col("sla_status").isin("MAYBE", "NO"))), path)
    back = spark.read.json(path)
    return back.select("record_id", "record_context.brand", "record_context.data_year", "detection_summary.final_severity", "sla.status")


@query(
    "prescriber_anomaly_sink", "A13",
    pr.FUSED_SQL + f" SELECT CAST(npi AS VARCHAR) AS record_id, true AS anomaly_detected, CAST(round(CAST(CAST(isolation_score AS VARCHAR) AS DECIMAL(30,20)), 6) AS DOUBLE) AS ml_anomaly_score FROM pr_fused WHERE {pr.DETECTED_SQL}",
)
def prescriber_anomaly_sink(spark, sf_dir):
    """The anomalous records alone, as they are read back from the sink. Their texts repeat each other, so the files are compressed."""
    path = scratch_path(spark, "prescriber-json")
    sinks.write_anomalies(prescriber_documents(spark, sf_dir), path, compression="gzip")
    return spark.read.json(path).select("record_id", "anomaly_detected", F.col("ml_anomaly_score").cast("double").alias("ml_anomaly_score"))


@query(
    "appended_anomaly_store", "A12 G8",
    views.with_views("anomalies") + ", b AS (SELECT *, CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 0 ELSE 1 END AS batch FROM anomalies) "
    "SELECT record_id, source_dataset, severity FROM (SELECT *, row_number() OVER (PARTITION BY record_id, source_dataset ORDER BY batch, severity) AS r FROM b) WHERE r = 1",
)
def appended_anomaly_store(spark, sf_dir):
    """Two batches with overlapping keys end up once per key in the store, by the order of their columns."""
    found = views.anomalies(spark, sf_dir).select("record_id", "source_dataset", "severity")
    path = scratch_path(spark, "anomaly-store")
    sinks.append_new(found.where("severity IN ('HIGH', 'CRITICAL')"), path, ["record_id", "source_dataset"])
    sinks.append_new(found, path, ["record_id", "source_dataset"])
    return spark.read.parquet(path).select("record_id", "source_dataset", "severity")


@query(
    "appended_keyed_store", "A12 G8",
    views.with_views("anomalies") + ", b AS (SELECT *, CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 0 ELSE 1 END AS batch FROM anomalies) "
    "SELECT record_id, source_dataset, severity FROM (SELECT *, row_number() OVER (PARTITION BY record_id, source_dataset ORDER BY batch, severity) AS r FROM b) WHERE r = 1",
)
def appended_keyed_store(spark, sf_dir):
    """The same through buckets, of which an append reads those that its keys may be in."""
    found = views.anomalies(spark, sf_dir).select("record_id", "source_dataset", "severity")
    path = scratch_path(spark, "keyed-store")
    keyed_store.append_by_bucket(found.where("severity IN ('HIGH', 'CRITICAL')"), path, ["record_id", "source_dataset"])
    keyed_store.append_by_bucket(found, path, ["record_id", "source_dataset"])
    return keyed_store.read_store(spark, path).select("record_id", "source_dataset", "severity")
