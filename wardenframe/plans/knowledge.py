"""Document, retrieval, explanation and recommendation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.functions.columns import with_scalars
from wardenframe.functions.tables import register_tables
from wardenframe.operators import advice as ad
from wardenframe.operators import authorization as au
from wardenframe.operators import causes as ca
from wardenframe.operators import claims as cm
from wardenframe.operators import prescriber as ps
from wardenframe.operators import records as rc
from wardenframe.operators import retrieval as rt
from wardenframe.operators import sla
from wardenframe.operators import vector_index as vi
from wardenframe.plans import authorization as pa
from wardenframe.plans import claims as pc
from wardenframe.plans import pharmacy as pp
from wardenframe.plans import prescriber as pr
from wardenframe.plans import views
from wardenframe.plans.models import RISK_SQL, service_risk
from wardenframe.plans.registry import query
from wardenframe.session import materialise
from wardenframe.sources.scans import with_knowledge_metadata
from wardenframe.sources.tables import read_table


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- documents

_WS = "concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160), chr(5760), " + ", ".join(f"chr({c})" for c in range(0x2000, 0x200B)) + ", chr(8232), chr(8233), chr(8239), chr(8287), chr(12288))"


_CHUNKS_SQL = (
    f"WITH d AS (SELECT doc_id, source, lang, trim(text, {_WS}) AS t FROM documents), n AS (SELECT *, CAST(greatest(ceil((length(t) - 800) / 680.0), 0) AS INT) AS last FROM d WHERE length(t) > 0), "
    f"c AS (SELECT doc_id, source, lang, i, trim(substring(t, CAST(i * 680 + 1 AS BIGINT), 800), {_WS}) AS chunk FROM (SELECT *, unnest(generate_series(0, last)) AS i FROM n)) "
    "SELECT doc_id, source, lang AS category, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_id, chunk AS text FROM c WHERE chunk <> ''"
)


@query("document_chunks", "O1", _CHUNKS_SQL)
def document_chunks(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("category"), "text")
    return rt.chunk_documents(docs.withColumnRenamed("text", "body"), "body", ["doc_id", "source", "category"])


@query("document_chunks_by_sql", "O1", _CHUNKS_SQL)
def document_chunks_by_sql(spark, sf_dir):
    """The same as a table function that SQL joins laterally."""
    register_tables(spark)
    docs = read_table(spark, sf_dir, "documents")
    return spark.sql("SELECT d.doc_id, d.source, d.lang AS category, c.chunk_id, c.text FROM {docs} d, LATERAL chunks(d.text, 800, 120) c", docs=docs)


@query(
    "knowledge_documents", "A11",
    "SELECT trim(text) AS content, CASE WHEN doc_id % 10 = 0 THEN 'general' ELSE lang END AS category, concat('doc', doc_id, '.md') AS source FROM documents WHERE trim(text) <> ''",
)
def knowledge_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    path = F.concat(F.lit("file:/kb/docs/"), F.when(F.col("doc_id") % 10 != 0, F.concat(F.col("lang"), F.lit("/"))).otherwise(""), name)
    return with_knowledge_metadata(docs.select(F.col("text").alias("content"), path.alias("p")), F.col("p"), "kb/docs")


# ---------------------------------------------------------------- retrieval over the embeddings table

# Vectors whose number 20 divides stand for anomalies, all vectors for knowledge chunks; chunk text is the document of the same number.
_PATTERNS = ("Invalid date sequence", "Missing documentation", "Duplicate record", "Schema mismatch", "Reconciliation gap", "Provider mismatch", "Delayed processing", "Unusual cost")
_PATTERN = "CASE CAST(vec_id / 20 AS INT) % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATTERNS)) + " END"
_PATTERN_SQL = _PATTERN.replace("CAST(vec_id / 20 AS INT)", "(vec_id // 20)")
_TERMS = ("data", "the", "claims", "verify", "missing-value")

CANDIDATES_SQL = (
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), nv AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v), "
    "q AS (SELECT * FROM nv WHERE vec_id % 20 = 0), c AS (SELECT * FROM nv), "
    "p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, concat('src', c.label) AS source, list_dot_product(q.e, c.e) / (CASE WHEN q.n = 0 THEN 1 ELSE q.n END * CASE WHEN c.n = 0 THEN 1 ELSE c.n END) AS similarity FROM q, c), "
    "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM p WHERE similarity >= 0.35) WHERE r <= 20)"
)


def _vectors(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    anomalies = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.expr(_PATTERN).alias("pattern"))
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"))
    return anomalies, chunks


def candidates(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    anomalies, chunks = _vectors(spark, sf_dir)
    near = rt.cosine_top_k(anomalies, chunks, max(4 * rt.TOP_K, 20), **limits)
    return near.join(chunks.select("chunk_id", "source"), "chunk_id")


@query("similar_chunks", "O4 G10", CANDIDATES_SQL + " SELECT query_id, chunk_id, source, round(similarity, 6) AS similarity FROM k")
def similar_chunks(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "chunk_id", "source", F.round("similarity", 6).alias("similarity"))


@query("similar_chunks_by_blocks", "O4 G10", CANDIDATES_SQL + " SELECT query_id, chunk_id, source, round(similarity, 6) AS similarity FROM k")
def similar_chunks_by_blocks(spark, sf_dir):
    """The same through many small blocks."""
    return candidates(spark, sf_dir, tile_bytes=1 << 14).select("query_id", "chunk_id", "source", F.round("similarity", 6).alias("similarity"))


@query("similar_chunks_by_index", "O4 G10", CANDIDATES_SQL + " SELECT query_id, chunk_id, source, round(similarity, 6) AS similarity FROM k")
def similar_chunks_by_index(spark, sf_dir):
    """The same through the inverted-file index, which goes on to every cell that may hold a better neighbour."""
    anomalies, chunks = _vectors(spark, sf_dir)
    near = vi.search_index(vi.build_index(chunks), anomalies, max(4 * rt.TOP_K, 20), probes=2)
    return near.join(chunks.select("chunk_id", "source"), "chunk_id").select("query_id", "chunk_id", "source", F.round("similarity", 6).alias("similarity"))


_TOP_SQL = CANDIDATES_SQL.split(", k AS (")[0] + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM p WHERE similarity >= 0.35) WHERE r <= 10)"


@query("index_recall", "O4 G10 I6", _TOP_SQL + " SELECT count(DISTINCT query_id) AS queries, count(*) AS pairs, true AS recall_reached FROM k")
def index_recall(spark, sf_dir):
    """Ten neighbours from the lists of the nearest cells alone, as many as a few exact searches ask for, measured against comparing all pairs."""
    anomalies, chunks = _vectors(spark, sf_dir)
    index = vi.build_index(chunks)
    probes = vi.tuned_probes(index, anomalies, 10)
    measured = vi.recall(vi.search_index(index, anomalies, 10, probes=probes, exact=False), rt.cosine_top_k(anomalies, chunks, 10))
    return measured.select("queries", "pairs", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("index_lists", "O4", "SELECT count(*) AS vectors, count(*) AS listed, count(DISTINCT embedding) AS entries FROM embeddings")
def index_lists(spark, sf_dir):
    """Every vector is in a list, copies with their first one."""
    _, chunks = _vectors(spark, sf_dir)
    index = vi.build_index(chunks)
    listed = index.lists.select("rep").join(index.copies, "rep").agg(F.count_distinct("chunk_id").alias("listed"), F.count_distinct("rep").alias("entries"))
    return with_scalars(listed, chunks.agg(F.count(F.lit(1)).alias("vectors")), "_v").select("_v.vectors", "listed", "entries")


_CUT_SQL = (
    CANDIDATES_SQL.split(", k AS (")[0] + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM p WHERE similarity >= -0.2) WHERE r <= 5)"
)


@query("nearest_chunks_cut", "O4 I6", _CUT_SQL + " SELECT query_id, chunk_id, source, round(similarity, 6) AS similarity FROM k")
def nearest_chunks_cut(spark, sf_dir):
    """Five of the many chunks above a low threshold, so that the cut itself is compared."""
    anomalies, chunks = _vectors(spark, sf_dir)
    near = rt.cosine_top_k(anomalies, chunks, 5, threshold=-0.2, tile_bytes=1 << 15)
    return near.join(chunks.select("chunk_id", "source"), "chunk_id").select("query_id", "chunk_id", "source", F.round("similarity", 6).alias("similarity"))


_WIDE_SQL = (
    CANDIDATES_SQL.replace("similarity >= 0.35", "similarity >= -0.2") + ", s AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY similarity DESC, chunk_id) AS sr FROM k), "
    "ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(sr > 1 AS INT), similarity DESC, chunk_id) AS cr FROM s) WHERE cr <= 5), "
    "rt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM ch)"
)


@query("diverse_chunks_cut", "O7 I6", _WIDE_SQL + " SELECT query_id, chunk_id, source, CAST(rank AS INT) AS rank FROM rt")
def diverse_chunks_cut(spark, sf_dir):
    """One chunk per source first, then back-fill, out of twenty candidates per query."""
    anomalies, chunks = _vectors(spark, sf_dir)
    near = rt.cosine_top_k(anomalies, chunks, 20, threshold=-0.2).join(chunks.select("chunk_id", "source"), "chunk_id")
    return rt.diversify(near.withColumnRenamed("similarity", "hybrid_score")).select("query_id", "chunk_id", "source", "rank")


_NORM_TERMS = [t.replace("-", " ") for t in _TERMS]
HYBRID_SQL = (
    CANDIDATES_SQL + ", h0 AS (SELECT k.*, d.text, regexp_replace(lower(d.text), '[^a-z0-9_]+', ' ', 'g') AS body FROM k LEFT JOIN documents d ON d.doc_id = k.chunk_id), "
    "h AS (SELECT *, (" + " + ".join(f"CAST(contains(body, '{t}') AS INT)" for t in _NORM_TERMS) + f") / {len(_TERMS)} AS evidence_score FROM h0), "
    "hy AS (SELECT *, round(similarity * 0.7 + evidence_score * 0.3, 9) AS hybrid_score FROM h)"
)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    joined = candidates(spark, sf_dir).join(text, "chunk_id", "left").withColumn("terms", F.array(*[F.lit(t) for t in _TERMS]))
    return rt.add_hybrid(joined)


@query("hybrid_scores", "O5 O6", HYBRID_SQL + " SELECT query_id, chunk_id, evidence_score, round(hybrid_score, 6) AS hybrid_score FROM hy")
def hybrid_scores(spark, sf_dir):
    return hybrid(spark, sf_dir).select("query_id", "chunk_id", "evidence_score", F.round("hybrid_score", 6).alias("hybrid_score"))


RETRIEVED_SQL = (
    HYBRID_SQL + ", s AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY hybrid_score DESC, chunk_id) AS sr FROM hy), "
    "ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(sr > 1 AS INT), hybrid_score DESC, chunk_id) AS cr FROM s) WHERE cr <= 5), "
    "rt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS rank FROM ch)"
)


@query("diverse_top_chunks", "O7 I6", RETRIEVED_SQL + " SELECT query_id, chunk_id, source, CAST(rank AS INT) AS rank FROM rt")
def diverse_top_chunks(spark, sf_dir):
    return rt.diversify(hybrid(spark, sf_dir)).select("query_id", "chunk_id", "source", "rank")


MATCHED_SQL = (
    RETRIEVED_SQL + f", pt AS (SELECT vec_id AS query_id, {_PATTERN_SQL} AS pattern FROM embeddings WHERE vec_id % 20 = 0), "
    "mt0 AS (SELECT rt.*, pt.pattern, concat_ws(',', CASE WHEN contains(lower(text), lower(pattern)) THEN lower(pattern) END, CASE WHEN contains(lower(text), 'authorization') THEN 'authorization' END, CASE WHEN contains(lower(text), 'data') THEN 'data' END) AS matched_terms "
    "FROM rt JOIN pt ON pt.query_id = rt.query_id WHERE hybrid_score >= 0.35), "
    "mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (matched_terms <> '') DESC, hybrid_score DESC, chunk_id) AS match_rank FROM mt0) WHERE match_rank <= 5)"
)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    anomalies, _ = _vectors(spark, sf_dir)
    found = rt.diversify(hybrid(spark, sf_dir)).join(anomalies.select("query_id", "pattern"), "query_id")
    return rt.match_knowledge(found.withColumn("terms", F.array(F.lower("pattern"), F.lit("authorization"), F.lit("data"))), "terms")


@query("matched_knowledge", "O8", MATCHED_SQL + " SELECT query_id, chunk_id, matched_terms, matched_terms <> '' AS evidence_match, CAST(match_rank AS INT) AS match_rank FROM mt")
def matched_knowledge(spark, sf_dir):
    return matched(spark, sf_dir).select("query_id", "chunk_id", F.array_join("matched_terms", ",").alias("matched_terms"), "evidence_match", "match_rank")


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _knowledge_sql() -> str:
    parts = []
    for words, needed, one_of, text in ad.KNOWLEDGE_PATTERNS:
        need = "".join(f" AND contains(lower(text), '{w}')" for w in needed)
        parts.append(f"WHEN hybrid_score >= 0.5 AND {_any('lower(pattern)', words)} AND {_any('lower(text)', one_of)}{need} THEN {_q(text)}")
    return "CASE " + " ".join(parts) + " END"


FACTS_SQL = (
    MATCHED_SQL + f", kp AS (SELECT *, {_knowledge_sql()} AS procedure FROM mt), "
    "f AS (SELECT query_id, max(hybrid_score) AS best_score, bool_or(hybrid_score >= 0.5) AS has_strong, count(*) AS match_count, arg_min(procedure, match_rank) FILTER (procedure IS NOT NULL) AS knowledge_procedure FROM kp GROUP BY query_id), "
    "a AS (SELECT pt.query_id, pt.pattern, best_score, coalesce(has_strong, false) AS has_strong, coalesce(match_count, 0) AS match_count, knowledge_procedure FROM pt LEFT JOIN f ON f.query_id = pt.query_id)"
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    anomalies, _ = _vectors(spark, sf_dir)
    return anomalies.select("query_id", "pattern").join(ad.knowledge_facts(matched(spark, sf_dir)), "query_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))


_CAUSE_CASES = " ".join(f"WHEN {_any('lower(pattern)', words)} THEN {_q(text)}" for words, text, _ in ad.ROOT_CAUSE_PATTERNS)
_BASIS_CASES = " ".join(f"WHEN {_any('lower(pattern)', words)} THEN '{name}'" for words, _, name in ad.ROOT_CAUSE_PATTERNS)


@query(
    "root_cause_identification", "O9",
    FACTS_SQL + f", cc AS (SELECT *, CASE {_CAUSE_CASES} END AS known, CASE {_BASIS_CASES} END AS b FROM a) SELECT query_id, pattern, CASE WHEN known IS NOT NULL THEN 'likely' WHEN has_strong THEN 'possible' ELSE 'undetermined' END AS cause_status, "
    f"coalesce(known, CASE WHEN has_strong THEN {_q(ad.SUPPORTED_CAUSE)} ELSE {_q(ad.UNKNOWN_CAUSE)} END) AS cause, coalesce(b, CASE WHEN has_strong THEN pattern ELSE '' END) AS cause_basis, "
    "CASE WHEN NOT (known IS NOT NULL OR has_strong) THEN 'Low' WHEN best_score >= 0.7 THEN 'High' WHEN best_score >= 0.5 THEN 'Medium' ELSE 'Low' END AS cause_confidence FROM cc",
)
def root_cause_identification(spark, sf_dir):
    return ad.identify_root_cause(facts(spark, sf_dir)).select("query_id", "pattern", "cause_status", "cause", "cause_basis", "cause_confidence")


_RESOLUTION_CASES = " ".join(f"WHEN {_any('lower(pattern)', words)} THEN {_q(text)}" for words, text in ad.RESOLUTION_PATTERNS)


@query(
    "resolution_procedures", "O11",
    FACTS_SQL + f", cc AS (SELECT *, CASE {_RESOLUTION_CASES} END AS by_pattern FROM a) SELECT query_id, pattern, CASE WHEN coalesce(knowledge_procedure, by_pattern) IS NOT NULL THEN 'identified' ELSE 'review_required' END AS resolution_status, "
    f"coalesce(knowledge_procedure, by_pattern, {_q(ad.GENERIC_PROCEDURE)}) AS procedure, CASE WHEN knowledge_procedure IS NOT NULL THEN 'knowledge_base' WHEN by_pattern IS NOT NULL THEN 'anomaly_pattern' ELSE 'generic_data_quality_procedure' END AS resolution_basis FROM cc",
)
def resolution_procedures(spark, sf_dir):
    return ad.resolve(facts(spark, sf_dir)).select("query_id", "pattern", "resolution_status", "procedure", "resolution_basis")


_RISK = "CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN NULL ELSE floor(least(score, 200)) / 200.0 END"
_PRIORITY = "CASE WHEN risk >= 0.85 THEN 'Critical' WHEN risk >= 0.75 AND base <> 'Critical' THEN 'High' ELSE base END"


@query(
    "anomaly_priorities", "O10",
    views.with_views("anomalies") + f", r AS (SELECT id, anomaly_type, severity, {_RISK} AS risk, CASE severity WHEN 'CRITICAL' THEN 'Critical' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' ELSE 'Low' END AS base FROM anomalies), p AS (SELECT *, {_PRIORITY} AS priority FROM r) "
    "SELECT id, priority, CASE WHEN risk IS NOT NULL THEN concat(anomaly_type, ' detected with ', severity, ' severity and a risk score of ', printf('%.4f', risk), '. Operational priority: ', priority, '.') "
    "ELSE concat(anomaly_type, ' detected with ', severity, ' severity. Platform risk score unavailable. Operational priority: ', priority, '.') END AS admin_summary FROM p",
)
def anomaly_priorities(spark, sf_dir):
    df = views.anomalies(spark, sf_dir).withColumn("risk", F.expr(_RISK.replace("200.0", "200.0D")))
    df = df.withColumn("priority", ad.priority(F.col("severity"), F.col("risk")))
    return df.select("id", "priority", ad.admin_summary(F.col("anomaly_type"), F.col("severity"), F.col("risk"), F.col("priority")).alias("admin_summary"))


# ---------------------------------------------------------------- documents and canonical records


def auth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = au.final_flags(au.risk(au.model_texts(au.rule_texts(pa.explained(spark, sf_dir)))))
    return rc.authorization_document(full)


AUTH_SQL = (
    pa.NETWORK_SQL + f", {pa._POST}, dd AS (SELECT r.*, round(prob, 6) AS prob, list_transform({pa._TOP}, lambda x: x.n) AS causes, "
    f"CAST(least(least(rule_anomaly_count * 15, 50) + {pa._MODEL_PART} + {pa._BONUS}, 100) AS DOUBLE) AS risk_score FROM nw_rows r JOIN nw_act a ON a.pattern = r.pattern, nw_prior, nw_post), "
    "de AS (SELECT *, rule_anomaly_flag = 1 OR ml_anomaly_flag = 1 AS anomaly, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity, prob >= 0.5 AS net, "
    "CASE WHEN rule_anomaly_count = 0 THEN '' ELSE concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{c.upper()}' END" for c in au.CAUSES) + ") END AS rules, "
    "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in au.CAUSE_TEXTS.items()) + ") AS reasons FROM dd), "
    "au_doc AS (SELECT *, CASE WHEN NOT (anomaly OR net) THEN 'None' ELSE concat_ws(';', CASE WHEN rule_anomaly_flag = 1 THEN 'Rule' END, CASE WHEN ml_anomaly_flag = 1 THEN 'ML' END, CASE WHEN net THEN 'Bayesian' END) END AS signals, "
    "CASE WHEN ml_anomaly_flag = 1 THEN concat('Isolation Forest detected an unusual multivariate pattern with ', ml_anomaly_severity, ' severity.') ELSE '' END AS summary, "
    "CASE WHEN rules = '' THEN [] ELSE string_split(rules, ';') END AS rl FROM de)"
)


@query("auth_documents", "N5")
def auth_documents_json(spark, sf_dir):
    return auth_documents(spark, sf_dir).select(F.to_json(F.struct(*rc.DOCUMENT_FIELDS)).alias("document"))


@query("claims_documents", "N5")
def claims_documents_json(spark, sf_dir):
    return rc.claims_document(claims_final_rows(spark, sf_dir)).select(F.to_json(F.struct(*rc.DOCUMENT_FIELDS)).alias("document"))


@query(
    "claims_document_fields", "N5",
    pc.FINAL_SQL + " SELECT plan_id, CAST(issuer_id AS VARCHAR) AS issuer_id, final_anomaly = 1 AS anomaly, final_severity AS severity, anomaly_signal_count AS signal_count, anomaly_signals AS signals, bayesian_anomaly = 1 AS bayesian_anomaly, "
    "rule_anomaly = 1 AS rule_anomaly, rule_count, rule_name, evidence_count, evidence_severity FROM claims_final",
)
def claims_document_fields(spark, sf_dir):
    """Fields of every part of the nested document, whose evidence is that of the statistics."""
    docs = rc.claims_document(pc.final_claims(spark, sf_dir))
    return docs.select(
        "record_id.plan_id", "record_id.issuer_id", "final_assessment.anomaly", "final_assessment.severity", "final_assessment.signal_count", "final_assessment.signals",
        F.col("bayesian.anomaly").alias("bayesian_anomaly"), F.col("rule_engine.anomaly").alias("rule_anomaly"), "rule_engine.rule_count", "rule_engine.rule_name",
        "ml_evidence.evidence_count", F.col("ml_evidence.severity").alias("evidence_severity"),
    )


@query(
    "claims_canonical_fields", "N6",
    pc.FINAL_SQL + " SELECT concat(plan_id, '_', issuer_id) AS record_id, final_anomaly = 1 AS final_anomaly, final_severity, anomaly_signals AS anomaly_type, bayesian_anomaly = 1 AS bayesian_anomaly, rule_anomaly = 1 AS rule_anomaly, "
    "CAST(CASE WHEN rule_anomaly = 1 THEN len(list_filter(list_transform(string_split(rule_name, ';'), lambda x: trim(x)), lambda x: x <> '')) ELSE 0 END AS INT) AS rules, CAST(evidence_count AS INT) AS evidence_count FROM claims_final",
)
def claims_canonical_fields(spark, sf_dir):
    r = rc.canonical_record(rc.claims_document(pc.final_claims(spark, sf_dir)), "claims")
    d = "detection_summary"
    return r.select(
        "record_id", f"{d}.final_anomaly", f"{d}.final_severity", f"{d}.anomaly_type", f"{d}.bayesian_anomaly", f"{d}.rule_anomaly", F.size("rule_based_evidence").alias("rules"),
        F.col("ml_based_evidence.evidence_count").cast("int").alias("evidence_count"),
    )


def claims_final_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = materialise(pc.features(spark, sf_dir), "claims-features")
    rules = cm.apply_claims_rules(base).select("plan_id", "issuer_id", *pc._RULE_COLUMNS)
    evidence = pc.evidence(spark, sf_dir).select("plan_id", "issuer_id", "evidence_count", "evidence_severity", "evidence_summary")
    return cm.final_claims_verdict(cm.merge_signals(pc.score_table(base), rules, evidence))


@query("pharmacy_documents", "N5 A10")
def pharmacy_documents_json(spark, sf_dir):
    df = pp.with_sla(spark, sf_dir).where(F.col("final_anomaly") | F.col("sla_status").isin("MAYBE", "NO"))
    return rc.pharmacy_document(df).select("record_id", F.to_json(F.struct("*")).alias("document"))


@query(
    "pharmacy_document_fields", "N5 A10",
    pp.FULL_SQL + " SELECT 'pharmacy' AS dataset_type, CAST(npi AS VARCHAR) AS record_id, final_anomaly, final_severity, final_risk_score, rule_anomaly, rule_severity, rule_reason, ml_anomaly, behavior_anomaly, "
    "cost_per_claim_change, brand, CAST(data_year AS BIGINT) AS data_year, sla_status, sla_breach_probability, quality_risk, detection_source, explanation FROM ph_sla WHERE final_anomaly OR sla_status IN ('MAYBE', 'NO')",
)
def pharmacy_document_fields(spark, sf_dir):
    """Fields of every part of the nested document."""
    docs = rc.pharmacy_document(pp.with_sla(spark, sf_dir).where(F.col("final_anomaly") | F.col("sla_status").isin("MAYBE", "NO")))
    return docs.select(
        "dataset_type", "record_id", "detection_summary.final_anomaly", "detection_summary.final_severity", "detection_summary.final_risk_score", "rule_based_evidence.rule_anomaly",
        F.col("rule_based_evidence.severity").alias("rule_severity"), F.col("rule_based_evidence.reason").alias("rule_reason"), F.col("ml_based_evidence.is_anomaly").alias("ml_anomaly"),
        "detection_summary.behavior_anomaly", "behavior_based_evidence.cost_per_claim_change", "record_context.brand", F.col("record_context.data_year").cast("long").alias("data_year"),
        F.col("sla.status").alias("sla_status"), F.col("sla.breach_probability").alias("sla_breach_probability"), "sla.quality_risk", "explanation.detection_source", F.col("explanation.reason").alias("explanation"),
    )


@query(
    "prescriber_document_fields", "N5 A13",
    pr.FUSED_SQL + f" SELECT CAST(npi AS VARCHAR) AS record_id, {pr.DETECTED_SQL} AS anomaly_detected, rule_anomaly AS rule_based, isolation_anomaly AS isolation_forest, cluster_anomaly AS clustering, "
    f"behavior_anomaly AS behavioral, {pr._CAUSE_SQL} <> '' AS bayesian, {pr._CAUSE_SQL} AS causes FROM pr_fused",
)
def prescriber_document_fields(spark, sf_dir):
    docs = prescriber_documents(spark, sf_dir)
    named = F.transform("bayesian_probable_root_causes", lambda c: F.concat(c["cause"], F.lit(":"), c["probability_given_anomaly"].cast("string")))
    return docs.select("record_id", "anomaly_detected", "detection_sources.*", F.array_join(named, ",").alias("causes"))


def prescriber_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: the rows are counted before the risk, and the count would join and rule the whole table again.
    df = materialise(ps.root_causes(pr.fused(spark, sf_dir)), "prescriber-fused")
    breached = sla.prescriber_breach(df, workload_seconds=900.0, batch_size=1000).withColumn("causes", ca.lifted_causes(pr._flags(df)))
    return rc.prescriber_document(ps.record_verdict(breached, F.size("causes")), "npi")


@query("prescriber_documents", "N5 A13")
def prescriber_documents_json(spark, sf_dir):
    return prescriber_documents(spark, sf_dir).where("anomaly_detected").select("record_id", F.to_json(F.struct("*")).alias("document"))


_FUSION = (
    "concat('CL', event_id) AS claim_id", "concat('M', user_id) AS member_id", "CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'detected' ELSE 'no' END AS final_anomaly_flag",
    "CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS ml_anomaly_flag", "CASE event_id % 4 WHEN 0 THEN 'ml_only' WHEN 1 THEN 'RULE_ONLY' WHEN 2 THEN 'ML_AND_RULE' ELSE 'NONE' END AS detection_source",
    "CASE WHEN event_id % 5 = 0 THEN 'Normal' ELSE 'Billing_Anomaly' END AS final_anomaly_type", "CASE event_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN NULL WHEN 2 THEN 'odd' ELSE 'Critical' END AS final_severity",
    "CASE event_id % 7 WHEN 0 THEN 'RULE_001_A | RULE_018_OUT_OF_NETWORK' WHEN 1 THEN 'RULE_020_HIGH_PROCESSING_TIME' WHEN 2 THEN 'RULE_002_B|RULE_003_C' ELSE NULL END AS triggered_rules",
    "CASE WHEN event_id % 2 = 0 THEN 'MEDIUM' END AS rule_severity", "value AS ml_anomaly_score",
)


@query(
    "claim_fusion_documents", "M9 N5",
    "WITH f AS (SELECT event_id, " + ", ".join(_FUSION) + " FROM events), g AS (SELECT *, final_anomaly_flag IN ('yes', 'detected') AS a, ml_anomaly_flag = '1' AS m, upper(detection_source) AS src, "
    "CASE event_id % 7 WHEN 0 THEN ['RULE_001_A'] WHEN 2 THEN ['RULE_002_B', 'RULE_003_C'] ELSE [] END AS hard FROM f), "
    "h AS (SELECT *, CASE WHEN NOT a THEN 'NORMAL' WHEN upper(final_severity) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper(final_severity) ELSE 'LOW' END AS sev, "
    "CASE WHEN a THEN concat_ws('|', CASE WHEN src IN ('ML_ONLY', 'ML_AND_RULE') THEN 'ML_ANOMALY' END, CASE WHEN src IN ('RULE_ONLY', 'ML_AND_RULE') THEN 'RULE_ANOMALY' END, CASE WHEN final_anomaly_type <> 'Normal' THEN final_anomaly_type END) ELSE '' END AS sig FROM g) "
    "SELECT claim_id, a AS anomaly, sev AS severity, CASE WHEN NOT a THEN 'None' WHEN sig = '' THEN 'Anomaly detected' ELSE sig END AS signals, CASE WHEN sig = '' THEN 0 ELSE CAST(len(string_split(sig, '|')) AS INT) END AS signal_count, "
    "CAST(len(hard) AS INT) AS rule_count, CASE WHEN len(hard) > 0 THEN hard[1] ELSE 'NONE' END AS rule_name, CASE WHEN len(hard) > 0 THEN array_to_string(hard, '; ') ELSE 'No rule violation detected' END AS reason, "
    "CASE WHEN len(hard) = 0 THEN 'NONE' ELSE coalesce(rule_severity, 'LOW') END AS rule_severity, CASE WHEN m THEN final_anomaly_type ELSE '' END AS ml_types FROM h",
)
def claim_fusion_documents(spark, sf_dir):
    docs = rc.claim_fusion_document(read_table(spark, sf_dir, "events").selectExpr(*_FUSION, "value / 1000 AS ml_normalized_score"))
    return docs.select(
        "record_id.claim_id", "final_assessment.anomaly", "final_assessment.severity", "final_assessment.signals", "final_assessment.signal_count", "rule_engine.rule_count",
        "rule_engine.rule_name", "rule_engine.reason", F.col("rule_engine.severity").alias("rule_severity"), F.col("ml_evidence.types").alias("ml_types"),
    )


def auth_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.canonical_record(auth_documents(spark, sf_dir), "authorization")


@query(
    "auth_canonical_records", "N6",
    AUTH_SQL + " SELECT authorization_id AS record_id, anomaly AS final_anomaly, severity AS final_severity, risk_score AS final_risk_score, signals AS anomaly_type, CAST(len(rl) AS INT) AS rules, array_to_string(rl, ',') AS rule_names, "
    "net AS bayesian_anomaly, summary AS ml_summary, CAST(7 - CAST(patient_id IS NULL AS INT) - 1 AS INT) AS context_entries FROM au_doc",
)
def auth_canonical_records(spark, sf_dir):
    r = auth_canonical(spark, sf_dir)
    return r.select(
        "record_id", "detection_summary.final_anomaly", "detection_summary.final_severity", "detection_summary.final_risk_score", "detection_summary.anomaly_type", F.size("rule_based_evidence").alias("rules"),
        F.array_join("rule_based_evidence.rule_name", ",").alias("rule_names"), "detection_summary.bayesian_anomaly", F.col("ml_based_evidence.summary").alias("ml_summary"), F.size("record_context").alias("context_entries"),
    )


@query("claims_canonical_records", "N6")
def claims_canonical_records(spark, sf_dir):
    r = rc.canonical_record(rc.claims_document(claims_final_rows(spark, sf_dir)), "claims")
    return r.select("record_id", F.to_json(F.struct("*")).alias("record"))


def pharmacy_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pharmacy results in the shared document layout carry behaviour evidence and a context text."""
    df = pp.with_sla(spark, sf_dir)
    signals = F.concat_ws(",", F.when(F.col("rule_anomaly"), "Rule"), F.when(F.col("ml_anomaly"), "ML"), F.when(F.col("behavior_anomaly"), "Behavioral"))
    none = F.lit(None).cast("double")
    docs = df.select(
        F.struct(F.col("brand").alias("plan_id"), F.concat_ws("-", F.col("npi").cast("string"), F.col("data_year").cast("string")).alias("issuer_id")).alias("record_id"),
        F.struct(F.col("brand").alias("drug")).alias("entity"),
        F.struct(F.col("final_anomaly").alias("anomaly"), F.col("final_severity").alias("severity"), F.col("final_risk_score").alias("risk_score"), signals.alias("signals")).alias("final_assessment"),
        F.struct(F.lit(False).alias("anomaly"), none.alias("score"), none.alias("probability"), none.alias("threshold")).alias("bayesian"),
        F.struct(F.col("rule_anomaly").alias("anomaly"), F.col("rule_reason").alias("rule_name"), F.col("rule_reason").alias("reason"), F.col("rule_severity").alias("severity")).alias("rule_engine"),
        F.struct(F.col("ml_anomaly").alias("anomaly"), F.col("ml_anomaly_score").alias("score"), F.lit("Isolation Forest").alias("model")).alias("ml_evidence"),
        F.nullif("explanation", F.lit("")).alias("context_for_rag"),
    )
    return rc.canonical_record(docs, "pharmacy")


@query("pharmacy_canonical_records", "N6")
def pharmacy_canonical_records(spark, sf_dir):
    return pharmacy_canonical(spark, sf_dir).select("record_id", F.to_json(F.struct("*")).alias("record"))


@query(
    "pharmacy_canonical_fields", "N6",
    pp.FULL_SQL + " SELECT 'pharmacy' AS dataset_type, concat(brand, '_', npi, '-', data_year) AS record_id, final_anomaly, final_severity, final_risk_score, "
    "concat_ws(',', CASE WHEN rule_anomaly THEN 'Rule' END, CASE WHEN ml_anomaly THEN 'ML' END, CASE WHEN behavior_anomaly THEN 'Behavioral' END) AS anomaly_type, rule_anomaly, ml_anomaly, "
    "CAST(CASE WHEN rule_anomaly THEN len(list_filter(list_transform(string_split(rule_reason, ';'), lambda x: trim(x)), lambda x: x <> '')) ELSE 0 END AS INT) AS rules, CAST(behavior_anomaly AS INT) AS behaviours, "
    "nullif(explanation, '') AS source_explanation FROM ph_sla",
)
def pharmacy_canonical_fields(spark, sf_dir):
    r = pharmacy_canonical(spark, sf_dir)
    d = "detection_summary"
    return r.select(
        "dataset_type", "record_id", f"{d}.final_anomaly", f"{d}.final_severity", f"{d}.final_risk_score", f"{d}.anomaly_type", f"{d}.rule_anomaly", f"{d}.ml_anomaly",
        F.size("rule_based_evidence").alias("rules"), F.size("behavioral_evidence").alias("behaviours"), "source_explanation",
    )


@query(
    "auth_evidence_summary", "N7",
    AUTH_SQL + " SELECT authorization_id AS record_id, 'authorization' AS dataset_type, rule_anomaly_flag = 1 AS rule_anomaly, false AS ml_anomaly, true AS ml_evidence_available, array_to_string(rl, ',') AS rule_names, CAST(0 AS INT) AS features FROM au_doc",
)
def auth_evidence_summary(spark, sf_dir):
    s = rc.evidence_summary(rc.normalise_record(auth_canonical(spark, sf_dir)))
    return s.select("record_id", "dataset_type", "rule_anomaly", "ml_anomaly", "ml_evidence_available", F.array_join("rule_names", ",").alias("rule_names"), F.size("ml_features").alias("features"))


_STORE_LIST = RISK_SQL[: RISK_SQL.rindex("SELECT plan_id, issuer_id, anomaly_score")]


@query(
    "scored_store_rows", "N8",
    _STORE_LIST + "SELECT 'AUTHORIZATION' AS source_dataset, concat(plan_id, '-', issuer_id) AS record_id, 'SLA_PROCESSING_SPIKE' AS anomaly_type, CASE WHEN anomaly_score >= 0.75 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'OPEN' AS status, "
    "coalesce(l[1].f, 'multiple_fields') AS affected_field, 'Provider behaviour deviates from peer baseline.' AS likely_cause, 'Review record against provider history.' AS recommended_fix FROM r WHERE anomaly_score >= 0.55",
)
def scored_store_rows(spark, sf_dir):
    rows = rc.store_rows(service_risk(spark, sf_dir), F.concat("plan_id", F.lit("-"), F.col("issuer_id").cast("string")), F.col("anomaly_score") >= 0.55)
    return rows.drop("error_message")


_CONTEXT = (
    "concat_ws('; ', 'authorization id: ' || authorization_id, 'patient id: ' || patient_id, 'provider id: ' || provider_id, 'authorization type: ' || authorization_type, 'service code: ' || service_code)"
)


@query(
    "retrieval_query_texts", "O2",
    AUTH_SQL + " SELECT authorization_id AS record_id, concat_ws(' ', 'Healthcare data quality anomaly in authorization dataset.', concat('Record ID: ', authorization_id, '.'), CASE WHEN anomaly THEN 'Final anomaly: True.' ELSE 'Final anomaly: False.' END, "
    "concat('Severity: ', severity, '.'), concat('Risk score: ', CAST(risk_score AS VARCHAR), '.'), concat('Signal types: ', signals, '.'), CASE WHEN rules <> '' THEN concat('Rule violations: ', replace(rules, ';', ', '), '.') END, "
    "CASE WHEN rules <> '' THEN concat('Rule reasons: ', array_to_string(list_transform(rl, lambda x: reasons), '; '), '.') END, 'ML anomaly: False.', CASE WHEN summary <> '' THEN concat('ML summary: ', summary, '.') END, "
    f"CASE WHEN net THEN 'Bayesian anomaly: True.' ELSE 'Bayesian anomaly: False.' END, concat('Record context: ', {_CONTEXT}, '.'), {_q(rt.CLOSING['authorization'])}) AS query_text FROM au_doc",
)
def retrieval_query_texts(spark, sf_dir):
    """Texts without the model probabilities, whose printed form differs between engines."""
    r = auth_canonical(spark, sf_dir).withColumn("bayesian_evidence", F.col("bayesian_evidence").withField("probability", F.lit(None)).withField("score", F.lit(None)))
    return r.select("record_id", rt.query_text(F.struct("*")).alias("query_text"))


@query(
    "retrieval_evidence_terms", "O3",
    AUTH_SQL + " SELECT authorization_id AS record_id, array_to_string(list_filter(list_concat(['authorization'], CASE WHEN signals = 'None' THEN [] ELSE [signals] END, rl, CASE WHEN ml_anomaly_flag = 1 THEN ['MULTIVARIATE_ANOMALY', 'Isolation Forest'] ELSE [] END, CASE WHEN net THEN ['bayesian'] ELSE [] END), lambda x: x <> ''), '|') AS terms FROM au_doc",
)
def retrieval_evidence_terms(spark, sf_dir):
    return auth_canonical(spark, sf_dir).select("record_id", F.array_join(rt.evidence_terms(F.struct("*")), "|").alias("terms"))


_ROUTINE = {
    "explanation": "'No significant Authorization data-quality anomaly was detected.'",
    "admin": "concat('Authorization record ', authorization_id, ' does not currently show a final anomaly. No remediation is required.')",
}


@query(
    "record_explanations", "O12",
    AUTH_SQL + ", x AS (SELECT *, CASE WHEN len(rl) > 0 THEN list_transform(rl, lambda r: concat(r, ': ', reasons)) ELSE [] END AS rc FROM au_doc), y AS (SELECT *, array_to_string(list_concat(rc, CASE WHEN net THEN [concat('Bayesian evidence indicates anomalous behavior (probability=', CAST(prob AS VARCHAR), ').')] ELSE [] END), '; ') AS c0, "
    "CAST(len(rl) > 0 AS INT) + CAST(net AS INT) AS nb FROM x), z AS (SELECT *, CASE WHEN c0 = '' THEN 'The authorization record shows anomalous data-quality behavior requiring investigation.' ELSE c0 END AS cause FROM y) "
    f"SELECT authorization_id AS record_id, anomaly AS is_anomaly, CASE WHEN anomaly THEN concat_ws(' ', 'Authorization data quality anomaly', CASE WHEN len(rl) > 0 THEN concat('Rule evidence: ', array_to_string(rl, ', ')) END, CASE WHEN net THEN 'Bayesian evidence also indicates anomalous behavior.' END) ELSE {_ROUTINE['explanation']} END AS explanation, "
    "CASE WHEN anomaly THEN cause END AS cause, CASE WHEN anomaly THEN 'Medium' END AS confidence, CASE WHEN anomaly THEN concat_ws(',', CASE WHEN len(rl) > 0 THEN 'rule_evidence' END, CASE WHEN net THEN 'bayesian_evidence' END, CASE WHEN nb = 0 THEN 'source_evidence' END) ELSE '' END AS basis, "
    f"CASE WHEN anomaly THEN {_q(ad.PROCEDURES['authorization'])} ELSE {_q(ad.ROUTINE_ACTION)} END AS employee_action, "
    f"CASE WHEN anomaly THEN concat('Authorization anomaly detected for record ', authorization_id, ' with ', severity, ' severity. Authorization data quality anomaly Likely root cause: ', cause, ' Operational action: review and validate before reprocessing.') ELSE {_ROUTINE['admin']} END AS admin_summary FROM z",
)
def record_explanations(spark, sf_dir):
    e = ad.explain_record(auth_canonical(spark, sf_dir))
    return e.select("record_id", "is_anomaly", "explanation", "cause", "confidence", F.array_join("basis", ",").alias("basis"), "employee_action", "admin_summary")


_FB = {
    "rules": "CASE event_id % 3 WHEN 0 THEN ['invalid_date', 'missing_field'] ELSE [] END",
    "features": "CASE WHEN event_id % 3 = 1 THEN ['a_b', 'c_d', 'e_f', 'g_h'] ELSE [] END",
}


@query(
    "fallback_recommendations", "O13",
    f"WITH r AS (SELECT CAST(event_id AS VARCHAR) AS anomaly_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'claims' END AS dataset_type, CASE event_id % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Warning' ELSE 'odd' END AS severity, "
    f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(least(value, 200)) / 200.0 END AS risk, CASE WHEN event_id % 2 = 0 THEN 'at risk' ELSE '' END AS sla, {_FB['rules']} AS rl, {_FB['features']} AS fs FROM events), "
    "b AS (SELECT *, CASE severity WHEN 'Critical' THEN 'Critical' WHEN 'High' THEN 'High' ELSE 'Medium' END AS base FROM r) SELECT anomaly_id, coalesce(dataset_type, 'unknown') AS dataset_type, "
    "CASE WHEN dataset_type IS NULL THEN concat('Anomaly ', anomaly_id, ' was flagged by automated detection. RAG service is offline — manual review recommended.') ELSE concat('Anomaly ', anomaly_id, ' detected with ', severity, ' severity', CASE WHEN risk IS NULL THEN '' ELSE concat(' (risk score ', printf('%.4f', risk), ')') END, '. ', "
    "CASE WHEN len(rl) > 0 THEN 'Rule violations: invalid_date, missing_field. ' ELSE '' END, CASE WHEN len(fs) > 0 THEN 'ML flagged features: a_b, c_d, e_f. ' ELSE '' END, CASE WHEN sla <> '' THEN 'SLA: at risk.' ELSE '' END) END AS admin_summary, "
    "CASE WHEN dataset_type IS NULL THEN 'Undetermined (RAG service offline)' WHEN len(rl) > 0 THEN 'Invalid Date' ELSE 'ML statistical anomaly' END AS root_cause, "
    "CASE WHEN dataset_type IS NULL THEN 'Review the record in the source system, correct any data-quality issues, and revalidate before reprocessing.' WHEN len(rl) > 0 THEN 'Correct the rule violation(s): invalid date, missing field. Verify dates, document counts, and field values against the source system, then resubmit for processing.' "
    "WHEN len(fs) > 0 THEN 'Review the following flagged fields: a b, c d, e f. Compare observed values against expected ranges and correct any data-entry errors.' ELSE 'Review the flagged record in the source system, correct identified data-quality issues, and revalidate before reprocessing.' END AS employee_action, "
    "CASE WHEN dataset_type IS NULL THEN 'Medium' WHEN risk >= 0.85 THEN 'Critical' WHEN risk >= 0.75 AND base <> 'Critical' THEN 'High' ELSE base END AS priority FROM b",
)
def fallback_recommendations(spark, sf_dir):
    df = read_table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS anomaly_id", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'claims' END AS dataset_type",
        "CASE event_id % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Warning' ELSE 'odd' END AS severity",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(least(value, 200)) / 200.0D END AS risk_score", "CASE WHEN event_id % 2 = 0 THEN 'at risk' ELSE '' END AS sla",
        "CASE event_id % 3 WHEN 0 THEN array('invalid_date', 'missing_field') ELSE cast(array() as array<string>) END AS violated_rules",
        "CASE WHEN event_id % 3 = 1 THEN array('a_b', 'c_d', 'e_f', 'g_h') ELSE cast(array() as array<string>) END AS ml_features",
    )
    return ad.fallback_recommendation(df)
