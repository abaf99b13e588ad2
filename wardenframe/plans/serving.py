"""Anomaly-store queries: lists, counts, trends, SLA exposure and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenframe.functions.quantiles import cumulative_share
from wardenframe.operators import evaluation as evl
from wardenframe.operators import paging as pg
from wardenframe.operators import serving as sv
from wardenframe.operators import sla
from wardenframe.plans import pharmacy, views
from wardenframe.plans.registry import query
from wardenframe.plans.validation import TAGGED_SQL, tagged
from wardenframe.session import scratch_path
from wardenframe.sources.tables import read_table

A = views.with_views("anomalies")
AS_OF = "2024-02-01 00:00:00"


def _dec(e: str, digits: int = 4) -> str:
    return f"CAST(round(CAST({e} AS DECIMAL(20,9)), {digits}) AS DOUBLE)"


# ---------------------------------------------------------------- lists


@query("top_anomalies", "J1", A + " SELECT id, record_id, severity, score FROM anomalies ORDER BY score DESC, id LIMIT 20")
def top_anomalies(spark, sf_dir):
    return sv.top_by_score(views.anomalies(spark, sf_dir).select("id", "record_id", "severity", "score"), "score", ["id"])


_FILTER = "source_dataset = 'CLAIMS' AND severity = 'MEDIUM' AND status = 'OPEN' AND (record_id ILIKE '%c1%' OR anomaly_type ILIKE '%c1%' OR source_dataset ILIKE '%c1%')"


@query("anomaly_page", "J3", A + f" SELECT id, record_id, severity, status, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected FROM anomalies WHERE {_FILTER} ORDER BY detected_at DESC, id DESC OFFSET 20 LIMIT 20")
def anomaly_page(spark, sf_dir):
    found = sv.filter_anomalies(views.anomalies(spark, sf_dir), "CLAIMS", "MEDIUM", "OPEN", "c1")
    return sv.page(found, 2, 20).select("id", "record_id", "severity", "status", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss").alias("detected"))


@query("anomaly_page_by_ranges", "J3", A + f" SELECT id, record_id, severity, status, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected FROM anomalies WHERE {_FILTER} ORDER BY detected_at DESC, id DESC OFFSET 20 LIMIT 20")
def anomaly_page_by_ranges(spark, sf_dir):
    """The same page from a list that is kept in order; only the ranges that hold it are read."""
    path = scratch_path(spark, "anomaly-pages")
    pg.write_pages(sv.filter_anomalies(views.anomalies(spark, sf_dir), "CLAIMS", "MEDIUM", "OPEN", "c1"), path, ranges=8)
    return pg.read_page(spark, path, 2, 20).select("id", "record_id", "severity", "status", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss").alias("detected"))


@query("anomaly_page_total", "J3", A + f" SELECT count(*) AS total FROM anomalies WHERE {_FILTER}")
def anomaly_page_total(spark, sf_dir):
    return sv.filter_anomalies(views.anomalies(spark, sf_dir), "CLAIMS", "MEDIUM", "OPEN", "c1").agg(F.count(F.lit(1)).alias("total"))


@query("anomalies_sorted", "J4", A + " SELECT id, source_dataset, score FROM anomalies")
def anomalies_sorted(spark, sf_dir):
    return views.anomalies(spark, sf_dir).select("id", "source_dataset", "score").orderBy("score", "id")


@query(
    "anomaly_score_bands", "J5",
    A + " SELECT id, CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 20 THEN 'Medium' ELSE 'Low' END AS band FROM anomalies WHERE status = 'OPEN'",
)
def anomaly_score_bands(spark, sf_dir):
    return sv.filter_anomalies(views.anomalies(spark, sf_dir), status="OPEN").select("id", sv.score_band("score").alias("band"))


@query("document_keyword_search", "J6", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'data') OR contains(lower(source), 'data') OR contains(lower(lang), 'data')")
def document_keyword_search(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("tags", F.array("source", "lang"))
    return sv.keyword_search(docs, "text", "tags", "Data").select("doc_id", "source")


@query(
    "party_union", "J7 A5",
    "SELECT c_custkey AS party, 'customer' AS source_sheet, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, NULL FROM supplier",
)
def party_union(spark, sf_dir):
    from wardenframe.sources.scans import union_sheets

    customers = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS party", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS party", "s_acctbal AS balance")
    return union_sheets({"customer": customers, "supplier": suppliers})


@query("orders_without_lines", "J9", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def orders_without_lines(spark, sf_dir):
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    return orders.select(F.col("o_orderkey").alias("k")).subtract(lines.select(F.col("l_orderkey").alias("k")))


@query("customers_with_orders", "J10", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def customers_with_orders(spark, sf_dir):
    customers, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    return customers.select(F.col("c_custkey").alias("k")).intersect(orders.select(F.col("o_custkey").alias("k")))


@query(
    "anomaly_current_state", "J11 R4",
    A + " SELECT record_id, status, severity, id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY detected_at DESC, id DESC) AS r FROM anomalies) WHERE r = 1",
)
def anomaly_current_state(spark, sf_dir):
    log = views.anomalies(spark, sf_dir).select("record_id", "status", "severity", "id", "detected_at")
    return sv.latest_state(log, "record_id", "detected_at", "id").select("record_id", "status", "severity", "id")


@query(
    "new_anomalies_only", "G8 A12",
    A + ", known AS (SELECT DISTINCT record_id, source_dataset FROM anomalies WHERE severity = 'HIGH') SELECT id, record_id, source_dataset FROM anomalies a WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.record_id = a.record_id AND k.source_dataset = a.source_dataset)",
)
def new_anomalies_only(spark, sf_dir):
    store = views.anomalies(spark, sf_dir)
    return sv.new_records(store.select("id", "record_id", "source_dataset"), store.where("severity = 'HIGH'"), ["record_id", "source_dataset"])


@query(
    "claims_with_entity", "G7 I2",
    views.with_views("claims_raw") + ", e AS (SELECT claim_id, provider_id, claim_amount FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY provider_id, claim_amount, claim_date) AS r FROM claims_raw) WHERE r = 1) "
    "SELECT c.claim_id, c.claim_status, e.provider_id AS entity_provider, e.claim_amount AS entity_amount FROM claims_raw c LEFT JOIN e ON e.claim_id = c.claim_id",
)
def claims_with_entity(spark, sf_dir):
    claims = views.claims_raw(spark, sf_dir)
    entity = sv.first_per_key(claims.select("claim_id", "provider_id", "claim_amount", "claim_date"), ["claim_id"], ["provider_id", "claim_amount", "claim_date"])
    entity = entity.selectExpr("claim_id", "provider_id AS entity_provider", "claim_amount AS entity_amount")
    return claims.select("claim_id", "claim_status").join(entity, "claim_id", "left")


# ---------------------------------------------------------------- counts


@query(
    "pharmacy_severity_counts", "H2",
    pharmacy.FULL_SQL + " SELECT 'severity' AS measure, final_severity AS value, count(*) AS records FROM ph_sla GROUP BY ALL UNION ALL SELECT 'source', detection_source, count(*) FROM ph_sla GROUP BY ALL UNION ALL SELECT 'sla', sla_status, count(*) FROM ph_sla GROUP BY ALL",
)
def pharmacy_severity_counts(spark, sf_dir):
    """Three distributions from one pass: the record is unpacked into its three labels."""
    labels = F.array(
        F.struct(F.lit("severity").alias("measure"), F.col("final_severity").alias("value")),
        F.struct(F.lit("source").alias("measure"), F.col("detection_source").alias("value")),
        F.struct(F.lit("sla").alias("measure"), F.col("sla_status").alias("value")),
    )
    long = pharmacy.with_sla(spark, sf_dir).select(F.explode(labels).alias("l")).select("l.*")
    rank = F.when(F.col("value") == "NO", 1).when(F.col("value") == "MAYBE", 2).when(F.col("value") == "YES", 3)
    return sv.counts_by(long, "measure", "value").orderBy("measure", rank, F.desc("records"))


@query("signal_distribution", "H7", A + " SELECT source_dataset, severity, signal_count, count(*) AS records FROM anomalies GROUP BY ALL")
def signal_distribution(spark, sf_dir):
    return sv.counts_by(views.anomalies(spark, sf_dir), "source_dataset", "severity", "signal_count")


@query("anomalies_by_type", "H12", A + " SELECT anomaly_type, count(*) AS records FROM anomalies GROUP BY ALL")
def anomalies_by_type(spark, sf_dir):
    return sv.counts_by(views.anomalies(spark, sf_dir), "anomaly_type")


@query("anomaly_trend", "H12", A + " SELECT strftime(date_trunc('day', detected_at), '%Y-%m-%d') AS period, severity, count(*) AS anomalies FROM anomalies GROUP BY ALL")
def anomaly_trend(spark, sf_dir):
    return sv.trend(views.anomalies(spark, sf_dir), "detected_at", "day", "severity")


@query(
    "check_pass_rates", "H13",
    TAGGED_SQL + ", c AS (SELECT t AS type, count(*) AS checked, count(*) FILTER (f) AS failed FROM (SELECT 'completeness' AS t, e_blank_member_id AS f FROM tagged UNION ALL SELECT 'completeness', e_denial FROM tagged "
    "UNION ALL SELECT 'type', e_type_claim_date FROM tagged UNION ALL SELECT 'type', e_type_claim_amount FROM tagged UNION ALL SELECT 'domain', e_domain FROM tagged UNION ALL SELECT 'duplicate', e_copy FROM tagged) GROUP BY t), "
    "n AS (SELECT 'completeness' AS type, 2 AS k UNION ALL SELECT 'type', 2 UNION ALL SELECT 'domain', 1 UNION ALL SELECT 'duplicate', 1) "
    f"SELECT c.type, CAST(k AS BIGINT) AS checks, checked AS records_checked, failed AS records_failed, {_dec('(checked - failed) * 100.0 / checked')} AS pass_rate FROM c JOIN n ON n.type = c.type",
)
def check_pass_rates(spark, sf_dir):
    listed = [
        ("completeness", "member_id"), ("completeness", "denial_code"), ("type", "claim_date"), ("type", "claim_amount"), ("domain", "claim_status"), ("duplicate", "claim_id"),
    ]

    def failed(kind: str, column: str):
        return F.count_if(F.exists("errors", lambda e: (e["type"] == kind) & (e["column"] == column)))

    row = tagged(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *[failed(k, c).alias(f"f{i}") for i, (k, c) in enumerate(listed)])
    checks = row.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("type"), F.col("n").alias("checked"), F.col(f"f{i}").alias("failed")) for i, (k, _) in enumerate(listed)
    ])).alias("c")).select("c.*")
    return sv.check_pass_rates(checks, "type", "checked", "failed")


_HOURS = "CAST(CAST(id AS BIGINT) % 48 + 1 AS DOUBLE)"
_STATE = f"CASE WHEN e > h THEN 'breached' WHEN e > h * 0.8 THEN 'at_risk' ELSE 'on_track' END"
_SLA_SQL = (
    A + f", w AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(detected_at)) / 3600000000.0 AS e, CASE severity WHEN 'CRITICAL' THEN 240.0 WHEN 'HIGH' THEN 360.0 ELSE 600.0 END AS h FROM anomalies), "
    f"sl AS (SELECT *, {_STATE} AS sla_state, {_HOURS} AS resolution_hours FROM w)"
)


def _with_state(spark, sf_dir):
    hours = F.when(F.col("severity") == "CRITICAL", 240.0).when(F.col("severity") == "HIGH", 360.0).otherwise(600.0)
    df = views.anomalies(spark, sf_dir)
    state = sla.sla_state(F.col("detected_at"), hours, F.lit(AS_OF).cast("timestamp"))
    return df.withColumns({"sla_state": state, "resolution_hours": F.expr(_HOURS)})


@query("sla_states", "P7", _SLA_SQL + " SELECT id, severity, sla_state FROM sl")
def sla_states(spark, sf_dir):
    return _with_state(spark, sf_dir).select("id", "severity", "sla_state")


@query(
    "dashboard_summary", "H14",
    _SLA_SQL + f" SELECT count(*) AS total_records, {_dec(chr(99) + 'ount(*) FILTER (severity = ' + chr(39) + 'LOW' + chr(39) + ') * 100.0 / count(*)')} AS pass_rate, count(*) FILTER (status IN ('OPEN', 'IN_PROGRESS')) AS open_anomalies, "
    f"count(*) FILTER (sla_state = 'breached') AS sla_breaches, {_dec('avg(resolution_hours) FILTER (status = ' + chr(39) + 'RESOLVED' + chr(39) + ')')} AS avg_resolution_hours FROM sl",
)
def dashboard_summary(spark, sf_dir):
    return sv.dashboard_summary(_with_state(spark, sf_dir))


@query(
    "source_totals", "H15",
    A + ", s AS (SELECT source_dataset AS type, record_id, count(*) AS records, count(*) FILTER (severity IN ('HIGH', 'CRITICAL')) AS errors FROM anomalies GROUP BY ALL) "
    "SELECT type, count(*) AS sources, CAST(sum(records) AS BIGINT) AS records, CAST(sum(errors) AS BIGINT) AS errors, count(*) FILTER (errors = 0) AS healthy FROM s GROUP BY type",
)
def source_totals(spark, sf_dir):
    per_source = views.anomalies(spark, sf_dir).groupBy(F.col("source_dataset").alias("type"), "record_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("errors")
    )
    return sv.source_totals(per_source.withColumn("status", F.when(F.col("errors") == 0, "healthy").otherwise("error")), "type")


@query(
    "feedback_helpful_rate", "H16",
    f"SELECT count(*) AS feedback, count(*) FILTER (quality = 1) AS helpful, count(*) FILTER (quality <> 1) AS not_helpful, {_dec('count(*) FILTER (quality = 1) * 100.0 / count(*)')} AS helpful_rate FROM labels",
)
def feedback_helpful_rate(spark, sf_dir):
    return sv.helpful_rate(read_table(spark, sf_dir, "labels"), F.col("quality") == 1)


@query(
    "recommendation_confidence", "H16",
    f"SELECT count(*) AS recommendations, {_dec('avg(CAST(least(value, 100) AS DECIMAL(20,4)))')} AS mean_confidence, count(*) FILTER (least(value, 100) >= 90) AS sure FROM events",
)
def recommendation_confidence(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select(F.least("value", F.lit(100.0)).alias("confidence"))
    return sv.confidence_summary(events, "confidence")


@query("sla_compliance", "H17", _SLA_SQL + f" SELECT count(*) AS items, {_dec('count(*) FILTER (sla_state <> ' + chr(39) + 'breached' + chr(39) + ') * 100.0 / count(*)')} AS compliance FROM sl")
def sla_compliance(spark, sf_dir):
    return sv.sla_compliance(_with_state(spark, sf_dir), "sla_state")


# ---------------------------------------------------------------- window-like


@query(
    "price_percentile_rank", "I3",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(cume_dist() OVER (ORDER BY l_extendedprice) * 100, 6) AS percentile_rank FROM lineitem",
)
def price_percentile_rank(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    ranks = cumulative_share(lines, "l_extendedprice")
    return lines.join(ranks, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", F.round("percentile_rank", 6).alias("percentile_rank"))


@query(
    "score_min_max", "I4",
    A + " SELECT id, (score - lo) / (hi - lo) AS scaled FROM anomalies, (SELECT min(score) AS lo, max(score) AS hi FROM anomalies)",
)
def score_min_max(spark, sf_dir):
    return sv.min_max(views.anomalies(spark, sf_dir).select("id", "score"), "score", "scaled").select("id", "scaled")


# ---------------------------------------------------------------- labels and SLA exposure

_RAW_LABEL = "CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'rule + ml' WHEN 1 THEN 'Rule' WHEN 2 THEN 'ML' WHEN 3 THEN 'normal' ELSE 'other' END"
_RAW_SEVERITY = "CASE CAST(id AS BIGINT) % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' WHEN 2 THEN 'LOW' WHEN 3 THEN 'critical' WHEN 4 THEN 'Normal' ELSE 'weird' END"


@query(
    "store_labels", "M10",
    A + f", r AS (SELECT id, upper({_RAW_LABEL}) AS t, upper({_RAW_SEVERITY}) AS s FROM anomalies) SELECT id, CASE s WHEN 'HIGH' THEN 'HIGH' WHEN 'LOW' THEN 'LOW' WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'NORMAL' THEN 'LOW' ELSE 'MEDIUM' END AS severity, "
    "CASE WHEN t LIKE '%RULE%' AND t LIKE '%ML%' THEN 'INVALID_DOMAIN' WHEN t LIKE '%RULE%' THEN 'NEGATIVE_VALUE' WHEN t LIKE '%ML%' THEN 'SLA_PROCESSING_SPIKE' ELSE 'MISSING_FIELD' END AS anomaly_type FROM r",
)
def store_labels(spark, sf_dir):
    return views.anomalies(spark, sf_dir).select("id", sv.store_severity(F.expr(_RAW_SEVERITY)).alias("severity"), sv.store_type(F.expr(_RAW_LABEL)).alias("anomaly_type"))


_W = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_LEVEL = "CASE WHEN risk_score <= 30 THEN 'LOW' WHEN risk_score <= 60 THEN 'MEDIUM' WHEN risk_score <= 80 THEN 'HIGH' ELSE 'CRITICAL' END"
_ACTION = "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in sla.ACTIONS.items()) + " END"
_FULL_TEXT = "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in sla.ACTIONS.items()) + " END"


def _flagged(spark, sf_dir):
    return views.anomalies(spark, sf_dir).withColumn("anomaly", F.col("signal_count") > 0)


@query(
    "record_sla_risk", "P3",
    A + f", s AS (SELECT id, CASE WHEN signal_count > 0 THEN {_dec(f'least(100.0, 50.0 + {_W} / 4.0 * 30 + least(signal_count, 3) / 3.0 * 20)', 2)} ELSE 0.0 END AS risk_score FROM anomalies), l AS (SELECT *, {_LEVEL} AS risk_level FROM s) "
    f"SELECT id, risk_score, risk_level, {_ACTION} AS action, {_FULL_TEXT} AS recommendation FROM l",
)
def record_sla_risk(spark, sf_dir):
    return sla.record_risk(_flagged(spark, sf_dir), "anomaly", "severity", "signal_count").select("id", "risk_score", "risk_level", "action", "recommendation")


_DATASETS_SQL = (
    A + f", g AS (SELECT source_dataset, count(*) AS record_count, count(*) FILTER (signal_count > 0) AS anomalous_records, {_dec('count(*) FILTER (signal_count > 0) * 100.0 / count(*)', 2)} AS anomaly_workload, "
    f"{_dec(f'sum({_W}) * 100.0 / (count(*) * 4)', 2)} AS severity_burden, {_dec('sum(least(signal_count, 3)) * 100.0 / (count(*) * 3)', 2)} AS signal_burden FROM anomalies GROUP BY source_dataset), "
    f"s AS (SELECT *, {_dec('greatest(0.0, least(100.0, anomaly_workload * 0.5 + severity_burden * 0.3 + signal_burden * 0.2))', 2)} AS risk_score FROM g), ds AS (SELECT *, {_LEVEL} AS risk_level FROM s)"
)


@query("dataset_sla_risk", "P4 P5", _DATASETS_SQL + f" SELECT *, {_ACTION} AS action FROM ds")
def dataset_sla_risk(spark, sf_dir):
    return sla.dataset_risk(_flagged(spark, sf_dir), "source_dataset", "anomaly", "severity", "signal_count")


@query(
    "overall_sla_risk", "P5 H8",
    _DATASETS_SQL + f", o AS (SELECT count(*) AS datasets_processed, CAST(sum(record_count) AS BIGINT) AS total_records, CAST(sum(anomalous_records) AS BIGINT) AS total_anomalous_records, {_dec('sum(risk_score * record_count) / sum(record_count)', 2)} AS risk_score FROM ds), "
    f"l AS (SELECT *, {_LEVEL} AS risk_level, {_dec('total_anomalous_records * 100.0 / total_records', 2)} AS overall_anomaly_rate FROM o) SELECT *, {_ACTION} AS action, {_FULL_TEXT} AS recommendation FROM l",
)
def overall_sla_risk(spark, sf_dir):
    return sla.overall_risk(dataset_sla_risk(spark, sf_dir))


_IDS = "CASE WHEN i % 3 = 0 THEN concat('AUTH', i) END AS authorization_id, CASE WHEN i % 5 = 0 THEN ' ' WHEN i % 2 = 0 THEN concat('CL', i) END AS claim_id, CASE WHEN i % 7 = 0 THEN NULL ELSE concat('REF', i) END AS reference"
_SIGNAL_TEXT = "CASE i % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Bayesian, Rule' WHEN 2 THEN 'Rule;ML' ELSE 'ML_ANOMALY|RULE_ANOMALY| ' END"


@query(
    "record_identity", "P6",
    f"WITH e AS (SELECT event_id AS i FROM events), d AS (SELECT i, {_IDS}, {_SIGNAL_TEXT} AS signals FROM e) SELECT i, coalesce(authorization_id, nullif(trim(claim_id), ''), reference, 'UNKNOWN') AS record_id, "
    "CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN 'Bayesian+Rule' WHEN 2 THEN 'Rule+ML' ELSE 'ML_ANOMALY+RULE_ANOMALY' END AS signals FROM d",
)
def record_identity(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("i"))
    docs = events.select("i", *[F.expr(e) for e in _split_top(_IDS)], F.expr(_SIGNAL_TEXT).alias("signals"))
    ids = docs.select("authorization_id", "claim_id", "reference")
    return docs.select("i", sla.record_identity(ids).alias("record_id"), F.array_join(sla.signal_names(F.col("signals")), "+").alias("signals"))


def _split_top(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for k, ch in enumerate(text):
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


# ---------------------------------------------------------------- evaluation

_EVAL = "WITH e AS (SELECT l.quality AS truth, d.n_chars / 20000.0 AS score, CAST(d.n_chars >= 1500 AS INT) AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _scored_labels(spark, sf_dir):
    labels, docs = read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = labels.join(docs, "doc_id")
    return joined.select(F.col("quality").alias("truth"), (F.col("n_chars") / 20000.0).alias("score"), (F.col("n_chars") >= 1500).cast("int").alias("predicted"))


@query(
    "label_metrics", "L14",
    _EVAL + ", c AS (SELECT count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) FILTER (truth = 0 AND predicted = 0) AS tn FROM e) "
    "SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c",
)
def label_metrics(spark, sf_dir):
    return evl.classification_metrics(_scored_labels(spark, sf_dir), "truth", "predicted")


@query(
    "label_roc_auc", "L14",
    _EVAL + ", r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM e), s AS (SELECT sum(rk) FILTER (truth = 1) AS sr, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM r) "
    "SELECT round((sr - p * (p + 1) / 2.0) / (p * n), 9) AS roc_auc FROM s",
)
def label_roc_auc(spark, sf_dir):
    return evl.roc_auc(_scored_labels(spark, sf_dir), "truth", "score").select(F.round("roc_auc", 9).alias("roc_auc"))


