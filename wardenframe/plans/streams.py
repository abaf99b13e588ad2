"""Streaming queries: files of the given tables drained with the available-now trigger."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wardenframe.operators import serving as sv
from wardenframe.plans import views
from wardenframe.plans.registry import query
from wardenframe.plans.validation import _CHECKS, _DATE, CONTRACT, TAGGED_SQL
from wardenframe.session import scratch_path
from wardenframe.sources.tables import read_table
from wardenframe.streaming import feeds, sinks


def _anomaly_stream(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    events = feeds.file_stream(spark, sf_dir, "events.parquet", schema)
    return views.anomaly_columns(events).withColumn("detected_at", F.col("detected_at").cast("timestamp"))


_ROW_BAD = (
    "(e_blank_claim_id OR e_blank_member_id OR e_blank_provider_id OR e_blank_claim_date OR e_type_claim_date OR e_blank_claim_amount OR e_type_claim_amount OR e_blank_claim_status OR e_denial OR e_domain OR e_range)"
)


@query(
    "claims_quarantine_stream", "R1",
    TAGGED_SQL + f" SELECT claim_id, provider_id, CASE WHEN {_ROW_BAD} THEN 'invalid' ELSE 'valid' END AS outcome FROM tagged",
)
def claims_quarantine_stream(spark, sf_dir):
    schema = read_table(spark, sf_dir, "lineitem").schema
    claims = views.claims_columns(feeds.file_stream(spark, sf_dir, "lineitem.parquet", schema))
    # Its SQL states the checks of single rows only; the form with unique claims is the next query.
    out = feeds.drain(feeds.quarantine(claims, replace(CONTRACT, unique=())), "claims", ("outcome",))
    return spark.read.parquet(out).select("claim_id", "provider_id", "outcome")


_NEAR = "(c.claimed_at - lag(c.claimed_at) OVER w <= INTERVAL 1 DAY OR lead(c.claimed_at) OVER w - c.claimed_at <= INTERVAL 1 DAY)"


@query(
    "claims_quarantine_stream_unique", "R1",
    TAGGED_SQL + f", c AS (SELECT *, {_DATE} AS claimed_at FROM tagged), m AS (SELECT c.*, claim_id IS NOT NULL AND coalesce({_NEAR}, false) AS e_repeat FROM c WINDOW w AS (PARTITION BY claim_id ORDER BY claimed_at NULLS FIRST)) "
    f"SELECT claim_id, provider_id, CASE WHEN {_ROW_BAD} OR e_repeat THEN 'invalid' ELSE 'valid' END AS outcome FROM m",
)
def claims_quarantine_stream_unique(spark, sf_dir):
    schema = read_table(spark, sf_dir, "lineitem").schema
    claims = views.claims_columns(feeds.file_stream(spark, sf_dir, "lineitem.parquet", schema))
    timed = claims.withColumn("claimed_at", F.expr("try_cast(claim_date AS timestamp)"))
    out = feeds.drain(feeds.quarantine(timed, CONTRACT, "claimed_at"), "claims-unique", ("outcome",))
    return spark.read.parquet(out).select("claim_id", "provider_id", "outcome")


_MARKED_SQL = TAGGED_SQL + (
    f", c AS (SELECT *, {_DATE} AS claimed_at FROM tagged), m AS (SELECT c.*, claim_id IS NOT NULL AND (coalesce({_NEAR}, false) OR claimed_at IS NULL AND count(*) FILTER (WHERE claimed_at IS NULL) OVER (PARTITION BY claim_id) > 1) AS e_repeat "
    "FROM c WINDOW w AS (PARTITION BY claim_id ORDER BY claimed_at NULLS FIRST))"
)


def _drained(spark, sf_dir) -> str:
    """The claims stream, put into sinks by outcome; their folder."""
    schema = read_table(spark, sf_dir, "lineitem").schema
    claims = views.claims_columns(feeds.file_stream(spark, sf_dir, "lineitem.parquet", schema))
    root = scratch_path(spark, "claims-sinks")
    tagged = feeds.quarantine(claims.withColumn("claimed_at", F.expr("try_cast(claim_date AS timestamp)")), CONTRACT, "claimed_at")
    sinks.drain_to_sinks(tagged, root, scratch_path(spark, "claims-sinks-state"))
    return root


@query(
    "claims_sink_rows", "R1 A8 C7",
    _MARKED_SQL + f" SELECT claim_id, member_id, provider_id, claim_date, CASE WHEN {_ROW_BAD} OR e_repeat THEN 'invalid' ELSE 'valid' END AS outcome FROM m",
)
def claims_sink_rows(spark, sf_dir):
    """Rows of both sinks, as readers see them through the ledger."""
    root = _drained(spark, sf_dir)
    both = sinks.committed_rows(spark, root, "valid").unionByName(sinks.committed_rows(spark, root, "invalid"))
    return both.select("claim_id", "member_id", "provider_id", "claim_date", "outcome")


@query(
    "claims_sink_report", "R1 C8 C9",
    _MARKED_SQL + " SELECT type, \"column\", count(*) AS rows FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS type, '{column}' AS \"column\" FROM m WHERE {name}" for name, _, kind, column, _ in _CHECKS if name != "e_copy")
    + " UNION ALL SELECT 'duplicate', 'claim_id' FROM m WHERE e_repeat) GROUP BY ALL"
    + f" UNION ALL SELECT 'outcome', CASE WHEN {_ROW_BAD} OR e_repeat THEN 'invalid' ELSE 'valid' END AS o, count(*) FROM m GROUP BY o",
)
def claims_sink_report(spark, sf_dir):
    """Issues of all batches that the ledger names, and what it says of their outcomes."""
    root = _drained(spark, sf_dir)
    issues = sinks.committed_issues(spark, root).groupBy("type", "column").agg(F.sum("rows").alias("rows"))
    outcomes = sinks.read_ledger(spark, root).unpivot("batch_id", ["valid", "invalid"], "column", "rows").groupBy(F.lit("outcome").alias("type"), "column").agg(F.sum("rows").alias("rows"))
    return issues.unionByName(outcomes)


@query("new_anomaly_stream", "R2", views.with_views("anomalies") + " SELECT DISTINCT record_id, source_dataset FROM anomalies")
def new_anomaly_stream(spark, sf_dir):
    out = feeds.drain(feeds.new_anomaly_feed(_anomaly_stream(spark, sf_dir), "detected_at"), "feed")
    return spark.read.parquet(out).select("record_id", "source_dataset")


# Windows are emitted once the watermark (newest event minus lateness) has passed their end.
_MARK = "(SELECT max(detected_at) - INTERVAL 1 HOUR AS w FROM anomalies)"


def _shape(df):
    text = "yyyy-MM-dd HH:mm:ss"
    return df.select(F.date_format("period_start", text).alias("period_start"), F.date_format("period_end", text).alias("period_end"), "severity", "anomalies")


@query(
    "anomaly_trend_stream", "R3",
    views.with_views("anomalies") + f", t AS (SELECT date_trunc('day', detected_at) AS s, severity, count(*) AS anomalies FROM anomalies GROUP BY ALL) "
    f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS period_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS period_end, severity, anomalies FROM t, {_MARK} WHERE s + INTERVAL 1 DAY <= w",
)
def anomaly_trend_stream(spark, sf_dir):
    out = feeds.drain(feeds.windowed_trend(_anomaly_stream(spark, sf_dir), "detected_at", "severity", "1 day"), "trend")
    return _shape(spark.read.parquet(out))


@query(
    "anomaly_sliding_stream", "R3",
    views.with_views("anomalies") + ", x AS (SELECT date_trunc('hour', detected_at) - INTERVAL (CAST(extract('hour' FROM detected_at) AS INT) % 6) HOUR - INTERVAL (k * 6) HOUR AS s, severity FROM anomalies, (SELECT unnest([0, 1]) AS k)), "
    "t AS (SELECT s, severity, count(*) AS anomalies FROM x GROUP BY ALL) "
    f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS period_start, strftime(s + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS period_end, severity, anomalies FROM t, {_MARK} WHERE s + INTERVAL 12 HOUR <= w",
)
def anomaly_sliding_stream(spark, sf_dir):
    out = feeds.drain(feeds.windowed_trend(_anomaly_stream(spark, sf_dir), "detected_at", "severity", "12 hours", "6 hours"), "sliding")
    return _shape(spark.read.parquet(out))


@query(
    "anomaly_session_stream", "R3",
    views.with_views("anomalies") + ", o AS (SELECT *, CASE WHEN detected_at - lag(detected_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM anomalies WINDOW w AS (PARTITION BY severity ORDER BY detected_at, id)), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY severity ORDER BY detected_at, id) AS n FROM o), t AS (SELECT severity, n, min(detected_at) AS s, max(detected_at) + INTERVAL 30 MINUTE AS e, count(*) AS anomalies FROM g GROUP BY ALL) "
    f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS period_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS period_end, severity, anomalies FROM t, {_MARK} WHERE e <= w",
)
def anomaly_session_stream(spark, sf_dir):
    out = feeds.drain(feeds.session_trend(_anomaly_stream(spark, sf_dir), "detected_at", "severity", "30 minutes"), "session")
    return _shape(spark.read.parquet(out))


@query(
    "anomaly_state_stream", "R4",
    views.with_views("anomalies") + " SELECT record_id, status, severity, id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY detected_at DESC, id DESC) AS r FROM anomalies) WHERE r = 1",
)
def anomaly_state_stream(spark, sf_dir):
    changes = _anomaly_stream(spark, sf_dir).select("record_id", "status", "severity", "id", F.col("detected_at").alias("at"))
    out = feeds.drain(feeds.current_state(changes), "state")
    return sv.latest_state(spark.read.parquet(out), "record_id", "at", "id").select("record_id", "status", "severity", "id")


@query(
    "anomaly_state_on_store", "R4 J11",
    views.with_views("anomalies") + " SELECT record_id, status, severity, id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY detected_at DESC, id DESC) AS r FROM anomalies) WHERE r = 1",
)
def anomaly_state_on_store(spark, sf_dir):
    """Half of the changes are in the store when the stream of the others begins; store and moves hold the state of all."""
    columns = ("record_id", "status", "severity", "id", F.col("detected_at").alias("at"))
    stored = "CAST(id AS BIGINT) % 2 = 0"
    store = views.anomalies(spark, sf_dir).where(stored).select(*columns).withColumn("at", F.col("at").cast("timestamp"))
    changes = _anomaly_stream(spark, sf_dir).where(f"NOT {stored}").select(*columns)
    moves = spark.read.parquet(feeds.drain(feeds.current_state(changes, store), "state"))
    return sv.latest_state(store.unionByName(moves), "record_id", "at", "id").select("record_id", "status", "severity", "id")
