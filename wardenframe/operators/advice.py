"""Root cause, resolution, priority and explanation texts of an anomaly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag, lookup, title_words

# Fixed values: (words looked for in the pattern, cause, basis), tried in order.
ROOT_CAUSE_PATTERNS = (
    (("invalid date",), "The service date occurs before the authorization date, indicating an invalid date-sequence data-quality issue. This may be caused by incorrect source data, date transformation issues, or upstream transmission problems.", "invalid_date_sequence"),
    (("missing document", "documentation"), "Required supporting documentation is missing from the affected record, indicating incomplete source or submission data.", "missing_documentation"),
    (("duplicate",), "The record appears to have been transmitted or created more than once, indicating a possible duplicate transmission or upstream duplication issue.", "duplicate_record"),
    (("schema",), "The affected record does not conform to the expected healthcare data schema, indicating a possible schema or source mapping issue.", "schema_mismatch"),
    (("reconciliation",), "The affected record does not reconcile with the corresponding source or downstream data, indicating a possible data synchronization or transformation issue.", "reconciliation_failure"),
)
SUPPORTED_CAUSE = "The available knowledge-base evidence supports the identified anomaly as a healthcare data-quality issue. The specific root cause should be verified against the source system before remediation."
UNKNOWN_CAUSE = "The available evidence is insufficient to determine a specific root cause. The affected record should be verified against the source system."
# Fixed values: (words in the pattern, procedure), tried in order.
RESOLUTION_PATTERNS = (
    (("invalid date",), "Verify the authorization date and service date against the source system. Correct the invalid date sequence, revalidate the record, and reprocess the authorization."),
    (("missing field", "missing data"), "Identify the missing required fields, verify the values against the source system, populate the missing information, and revalidate the record."),
    (("missing document", "documentation"), "Verify the required supporting documents. Obtain the missing documentation, update the record, and revalidate it before continuing processing."),
    (("duplicate",), "Compare the affected record with existing records in the source system to confirm the duplication. Retain the valid record, resolve the duplicate entry according to the remediation procedure, and revalidate the data."),
    (("schema",), "Compare the affected record with the expected schema. Correct the field or structure mismatch, validate the corrected record, and reprocess it."),
    (("reconciliation",), "Compare the affected record with the corresponding source or downstream record. Identify and correct the reconciliation difference, then rerun the reconciliation process."),
    (("delayed processing", "processing delay"), "Check the processing status and identify the stage causing the delay. Verify upstream and downstream pipeline status, resolve the blocking issue, and resume processing."),
    (("upstream",), "Verify the affected data against the upstream source. Identify the source of the incorrect or incomplete data, correct the upstream issue, and reprocess the affected records."),
    (("provider",), "Verify the affected provider data against the source system and applicable provider requirements. Correct the inaccurate or incomplete information and revalidate the record."),
)
# Fixed values: (pattern words, words all needed in the knowledge text, words of which one is needed, procedure).
KNOWLEDGE_PATTERNS = (
    (("invalid date",), (), ("verify", "correct", "reprocess"), "Verify the authorization date and service date against the source system. Correct the invalid date sequence and revalidate the record before reprocessing."),
    (("missing document", "documentation"), ("missing",), ("verify", "obtain"), "Verify the required supporting documentation. Obtain any missing documents, update the record, and revalidate it before continuing processing."),
    (("duplicate",), ("duplicate",), ("verify", "resolve"), "Verify whether the record is a true duplicate against the source system. Retain the valid record, resolve the duplicate entry, and revalidate the affected data."),
)
GENERIC_PROCEDURE = "Review the affected record against the source system and the applicable healthcare data-quality procedure. Correct the underlying issue, revalidate the record, and reprocess it only after validation succeeds."
STRONG_KNOWLEDGE = 0.50
PRIORITIES = {"critical": "Critical", "high": "High", "warning": "Medium", "medium": "Medium", "low": "Low"}
DEFAULT_PRIORITY = "Normal"


def _mentions(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def knowledge_facts(matched: DataFrame, pattern: str = "pattern", query: str = "query_id") -> DataFrame:
    """Per anomaly: best score, sources, and the first strong knowledge text that holds a resolution.

    The matched knowledge of an anomaly is at most five rows, so the lists here stay short.
    """
    low_pattern, low_text = F.lower(pattern), F.lower("text")
    strong = (F.col("hybrid_score") >= STRONG_KNOWLEDGE) & (F.col("text") != "")
    procedure = F.lit(None).cast("string")
    for words, needed, one_of, text in reversed(KNOWLEDGE_PATTERNS):
        fits = _mentions(low_pattern, words) & _mentions(low_text, one_of)
        for w in needed:
            fits = fits & F.contains(low_text, F.lit(w))
        procedure = F.when(strong & fits, text).otherwise(procedure)
    tagged = matched.withColumns({"_p": procedure, "_strong": strong})
    ranked = F.struct("match_rank", "source", "_p")
    return tagged.groupBy(query).agg(
        F.max("hybrid_score").alias("best_score"),
        F.max("_strong").alias("has_strong"),
        F.count(F.lit(1)).alias("match_count"),
        F.sort_array(F.collect_list(ranked)).alias("_k"),
    ).select(
        query, "best_score", "has_strong", "match_count", F.array_distinct(F.transform("_k", lambda k: k["source"])).alias("supporting_sources"),
        F.try_element_at(F.filter(F.transform("_k", lambda k: k["_p"]), lambda p: p.isNotNull()), F.lit(1)).alias("knowledge_procedure"),
    )


def knowledge_confidence(best: Column) -> Column:
    return F.when(best >= 0.70, "High").when(best >= 0.50, "Medium").otherwise("Low")


def identify_root_cause(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Status, cause, basis and confidence from the pattern, else from strong knowledge."""
    low = F.lower(F.coalesce(pattern, F.lit("")))
    cause = basis = None
    for words, text, name in ROOT_CAUSE_PATTERNS:
        hit = _mentions(low, words)
        cause = F.when(hit, text) if cause is None else cause.when(hit, text)
        basis = F.when(hit, name) if basis is None else basis.when(hit, name)
    known = cause.otherwise(F.lit(None).cast("string"))
    strong = flag(F.col("has_strong"))
    confidence = knowledge_confidence(F.coalesce("best_score", F.lit(0.0)))
    return df.select(
        "*",
        F.when(known.isNotNull(), "likely").when(strong, "possible").otherwise("undetermined").alias("cause_status"),
        F.coalesce(known, F.when(strong, SUPPORTED_CAUSE).otherwise(UNKNOWN_CAUSE)).alias("cause"),
        F.coalesce(basis.otherwise(F.lit(None).cast("string")), F.when(strong, F.col(pattern)).otherwise("")).alias("cause_basis"),
        F.when(known.isNotNull() | strong, confidence).otherwise("Low").alias("cause_confidence"),
    )


def resolve(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Procedure from knowledge, else from the pattern, else the generic one."""
    low = F.lower(F.coalesce(pattern, F.lit("")))
    by_pattern = None
    for words, text in RESOLUTION_PATTERNS:
        hit = _mentions(low, words)
        by_pattern = F.when(hit, text) if by_pattern is None else by_pattern.when(hit, text)
    by_pattern = by_pattern.otherwise(F.lit(None).cast("string"))
    found = F.coalesce("knowledge_procedure", by_pattern)
    return df.select(
        "*",
        F.when(found.isNotNull(), "identified").otherwise("review_required").alias("resolution_status"),
        F.coalesce(found, F.lit(GENERIC_PROCEDURE)).alias("procedure"),
        F.when(F.col("knowledge_procedure").isNotNull(), "knowledge_base").when(by_pattern.isNotNull(), "anomaly_pattern").otherwise("generic_data_quality_procedure").alias("resolution_basis"),
    )


def priority(severity: Column, risk: Column, default: str = DEFAULT_PRIORITY) -> Column:
    """By severity, raised by a high risk score."""
    base = lookup(PRIORITIES, F.lower(F.trim(severity)), F.lit(default))
    return F.when(risk >= 0.85, "Critical").when((risk >= 0.75) & (base != "Critical"), "High").otherwise(base)


def admin_summary(pattern: Column, severity: Column, risk: Column, level: Column) -> Column:
    name = F.when(F.coalesce(pattern, F.lit("")) == "", "data-quality anomaly").otherwise(pattern)
    tail = F.concat(F.lit("Operational priority: "), level, F.lit("."))
    head = F.concat(name, F.lit(" detected with "), severity, F.lit(" severity"))
    known = F.concat(head, F.lit(" and a risk score of "), F.format_string("%.4f", F.round(risk, 4)), F.lit(". "), tail)
    return F.when(risk.isNotNull(), known).otherwise(F.concat(head, F.lit(". Platform risk score unavailable. "), tail))


# ---------------------------------------------------------------- explanation of a canonical record

# Reason per rule without one, words taken as terms, procedure and pattern per data set.
RULE_REASONS = {
    "EXCESSIVE_IMPORTANT_MISSINGNESS": "At least 50% of important fields are missing.",
    "EXCESSIVE_SUPPRESSED_VALUES": "Record contains 10 or more suppressed or non-numeric values.",
    "unusual_cost_per_claim_change": "Cost per claim changed unusually compared with historical behavior.",
}
TERM_WORDS = (
    "bayesian", "behavioral", "cost_per_claim", "historical_behavior", "behavior", "claims", "missing", "suppressed", "provider", "payer", "authorization", "pharmacy",
)
PROCEDURES = {
    "claims": "Review the affected Claims record for missing or null important fields. Validate schema requirements, source-system transmission, field mapping, and transformation logic. Correct missing values where valid source data exists, revalidate the record, and reprocess only after validation succeeds.",
    "pharmacy": "Review the affected Pharmacy record against the source system and its historical baseline. Validate cost per claim, claim volume, related pharmacy metrics, and the detected behavioral change. Confirm whether the rule-based and Bayesian signals represent a genuine data-quality issue. Correct the underlying data if required, revalidate, and reprocess only after validation succeeds.",
    "authorization": "Review the affected Authorization record against the source system and applicable authorization validation rules. Correct the underlying issue, revalidate the record, and reprocess only after validation succeeds.",
}
PATTERNS = {
    "claims": "Excessive important-field missingness",
    "pharmacy": "Unusual pharmacy cost-per-claim behavior",
    "authorization": "Authorization data-quality anomaly",
}
ROUTINE_ACTION = "No action required. Continue normal processing."
ROUTINE_TEXT = "No remediation required. The record passed the current data-quality anomaly checks."


def explain_record(records: DataFrame, sources: str | None = None) -> DataFrame:
    """Explanation row of every canonical record. ``sources`` names an array column of knowledge sources.

    A record without a final anomaly gets the fixed routine texts.
    """
    d, ml, bayes = F.col("detection_summary"), F.col("ml_based_evidence"), F.col("bayesian_evidence")
    rules, behaviour = F.col("rule_based_evidence"), F.col("behavioral_evidence")
    dataset = F.lower(F.coalesce("dataset_type", F.lit("unknown")))
    shown = F.concat(F.upper(F.substring(dataset, 1, 1)), F.substring(dataset, 2, 1000))
    names = F.array_join(F.filter(F.transform(rules, lambda r: r["rule_name"]), lambda n: n.isNotNull()), ", ")
    source_text = F.coalesce("source_explanation", F.lit(""))
    knowledge = F.size(sources) > 0 if sources else F.lit(False)
    severity = F.upper(F.coalesce(d["final_severity"], F.lit("LOW")))
    quality = F.concat(shown, F.lit(" data quality anomaly"))
    description = (
        F.when((dataset == "claims") & (names != ""), F.concat(quality, F.lit(": "), names))
        .when((dataset == "claims") & (source_text != ""), F.concat(F.lit("Claims anomaly: "), source_text))
        .when(dataset.isin("pharmacy", "authorization") & (source_text != ""), source_text)
        .when((dataset == "pharmacy") & (names != ""), F.concat(F.lit("Pharmacy anomaly: "), names))
        .otherwise(quality)
    )
    behaves = F.exists(behaviour, lambda b: flag(b["detected"]))
    model, network = flag(ml["is_anomaly"]), flag(bayes["anomaly"])
    explanation = F.concat_ws(
        " ", F.col("_description"), F.when(names != "", F.concat(F.lit("Rule evidence: "), names)), F.when(model, "ML evidence indicates anomalous behavior."),
        F.when(network, "Bayesian evidence also indicates anomalous behavior."), F.when(behaves, "Behavioral evidence indicates a deviation from expected behavior."),
    )
    low = F.lower(source_text)
    terms = F.array_distinct(F.array_compact(F.concat(
        F.array(dataset, F.when(F.size(rules) > 0, "Rule"), F.when(F.size(behaviour) > 0, "Behavioral"), F.when(network, "Bayesian")),
        F.transform(rules, lambda r: r["rule_name"]),
        F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in TERM_WORDS]),
    )))
    rule_causes = F.transform(F.filter(rules, lambda r: r["rule_name"].isNotNull()), lambda r: F.concat(
        r["rule_name"], F.lit(": "), F.coalesce(F.nullif(r["reason"], F.lit("")), lookup(RULE_REASONS, r["rule_name"], F.lit("Rule violation detected.")))
    ))
    behaviour_text = F.when(dataset == "pharmacy", "Possible abnormal change in historical pharmacy cost behavior.").otherwise(
        F.try_element_at(F.transform(F.filter(behaviour, lambda b: flag(b["detected"])), lambda b: b["description"]), F.lit(1))
    )
    model_text = F.coalesce(F.nullif(ml["summary"], F.lit("")), F.nullif(ml["details"], F.lit("")), F.lit("ML model identified anomalous behavior."))
    network_text = F.concat(F.lit("Bayesian evidence indicates anomalous behavior (probability="), bayes["probability"].cast("string"), F.lit(")."))
    causes = F.array_compact(F.concat(rule_causes, F.array(F.when(model, model_text), F.when(network, network_text), F.when(behaves, behaviour_text))))
    bases = F.array_compact(F.array(F.when(F.size(rule_causes) > 0, "rule_evidence"), F.when(model, "ml_evidence"), F.when(network, "bayesian_evidence"), F.when(behaves, "behavioral_evidence")))
    no_cause = F.size(causes) == 0
    fallback = F.when(knowledge, F.concat(F.lit("The retrieved knowledge base contains relevant guidance for the detected "), dataset, F.lit(" data-quality anomaly."))).otherwise(
        F.concat(F.lit("The "), dataset, F.lit(" record shows anomalous data-quality behavior requiring investigation."))
    )
    cause = F.when(no_cause, fallback).otherwise(F.array_join(causes, "; "))
    basis = F.when(no_cause, F.array(F.when(knowledge, "knowledge_base").otherwise("source_evidence"))).otherwise(bases)
    other_procedure = F.concat(
        F.lit("Review the affected "), dataset,
        F.lit(" record against the source system and applicable healthcare data-quality procedures. Correct the underlying issue, revalidate the record, and reprocess only after validation succeeds."),
    )
    procedure = lookup(PROCEDURES, dataset, other_procedure)
    anomaly = flag(d["final_anomaly"])
    base = records.select(
        "*", anomaly.alias("_anomaly"), dataset.alias("_dataset"), shown.alias("_shown"), severity.alias("_severity"), description.alias("_description"),
        cause.alias("_cause"), basis.alias("_basis"), terms.alias("_terms"), procedure.alias("_procedure"),
    )
    on = F.col("_anomaly")

    def when_on(value: Column, off: Column) -> Column:
        return F.when(on, value).otherwise(off)

    none = F.lit(None).cast("string")
    quiet = F.concat(F.lit("No significant "), F.col("_shown"), F.lit(" data-quality anomaly was detected."))
    routine = F.concat(F.col("_shown"), F.lit(" record "), F.col("record_id"), F.lit(" does not currently show a final anomaly. No remediation is required."))
    summary = F.concat(
        F.col("_shown"), F.lit(" anomaly detected for record "), F.col("record_id"), F.lit(" with "), F.col("_severity"), F.lit(" severity. "), F.col("_description"),
        F.lit(" Likely root cause: "), F.col("_cause"), F.lit(" Operational action: review and validate before reprocessing."),
    )
    advice = F.concat(
        F.lit("The record contains a "), F.col("_shown"), F.lit(" data-quality issue: "), F.col("_description"), F.lit(" Likely cause: "), F.col("_cause"),
        F.lit(" Recommended action: "), F.col("_procedure"), F.lit(" This issue should be handled with "), F.initcap("_severity"), F.lit(" priority."),
    )
    empty = F.array().cast("array<string>")
    return base.select(
        "record_id", F.col("_dataset").alias("dataset_type"), on.alias("is_anomaly"), when_on(F.col("_description"), none).alias("anomaly"), F.col("_severity").alias("severity"),
        when_on(d["final_risk_score"], F.coalesce(d["final_risk_score"], F.lit(0.0))).alias("risk_score"),
        when_on(explanation, quiet).alias("explanation"), when_on(F.col("_terms"), empty).alias("evidence_terms"), when_on(F.size("_terms"), F.lit(0)).alias("match_count"),
        when_on(F.col("_cause"), none).alias("cause"), when_on(F.col("_basis"), empty).alias("basis"),
        when_on(F.when(F.size("_basis") >= 3, "High").otherwise("Medium"), none).alias("confidence"),
        when_on(F.col("_procedure"), F.lit(ROUTINE_ACTION)).alias("employee_action"),
        when_on(lookup(PATTERNS, F.col("_dataset"), F.concat(F.col("_dataset"), F.lit(" data-quality anomaly"))), none).alias("pattern"),
        when_on(summary, routine).alias("admin_summary"), when_on(advice, F.lit(ROUTINE_TEXT)).alias("recommendation"),
    )


# ---------------------------------------------------------------- recommendation without retrieval


def fallback_recommendation(df: DataFrame) -> DataFrame:
    """Recommendation from the stored record alone.

    Expects ``anomaly_id``, ``dataset_type``, ``severity``, ``risk_score``, ``sla`` and the arrays
    ``violated_rules`` and ``ml_features``; a NULL dataset means that no record is stored.
    """
    rules, features = F.col("violated_rules"), F.col("ml_features")
    has_rules, has_features = F.size(rules) > 0, F.size(features) > 0
    first_three = F.array_join(F.slice(features, 1, 3), ", ")
    missing = F.col("dataset_type").isNull()
    risk = F.col("risk_score")
    head = F.concat(
        F.lit("Anomaly "), F.col("anomaly_id"), F.lit(" detected with "), F.col("severity"), F.lit(" severity"),
        F.when(risk.isNotNull(), F.concat(F.lit(" (risk score "), F.format_string("%.4f", F.round(risk, 4)), F.lit(")"))).otherwise(""), F.lit(". "),
    )
    summary = F.concat(
        head,
        F.when(has_rules, F.concat(F.lit("Rule violations: "), F.array_join(rules, ", "), F.lit(". "))).otherwise(""),
        F.when(has_features, F.concat(F.lit("ML flagged features: "), first_three, F.lit(". "))).otherwise(""),
        F.when(F.coalesce("sla", F.lit("")) != "", F.concat(F.lit("SLA: "), F.col("sla"), F.lit("."))).otherwise(""),
    )
    offline = F.concat(F.lit("Anomaly "), F.col("anomaly_id"), F.lit(" was flagged by automated detection. RAG service is offline — manual review recommended."))
    spaced = F.replace(F.array_join(rules, ", "), F.lit("_"), F.lit(" "))
    action = (
        F.when(missing, "Review the record in the source system, correct any data-quality issues, and revalidate before reprocessing.")
        .when(has_rules, F.concat(F.lit("Correct the rule violation(s): "), spaced, F.lit(". Verify dates, document counts, and field values against the source system, then resubmit for processing.")))
        .when(has_features, F.concat(F.lit("Review the following flagged fields: "), F.replace(first_three, F.lit("_"), F.lit(" ")), F.lit(". Compare observed values against expected ranges and correct any data-entry errors.")))
        .otherwise("Review the flagged record in the source system, correct identified data-quality issues, and revalidate before reprocessing.")
    )
    primary = F.when(missing, "Undetermined (RAG service offline)").when(has_rules, title_words(F.try_element_at(rules, F.lit(1)))).otherwise("ML statistical anomaly")
    return df.select(
        "anomaly_id", F.coalesce("dataset_type", F.lit("unknown")).alias("dataset_type"), F.when(missing, offline).otherwise(summary).alias("admin_summary"),
        primary.alias("root_cause"), action.alias("employee_action"), F.when(missing, "Medium").otherwise(priority(F.col("severity"), risk, "Medium")).alias("priority"),
    )
