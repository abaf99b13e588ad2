"""Nested anomaly documents, their canonical form, and rows for the anomaly store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import TRUE_WORDS_WITH_DETECTED, flag, parse_bool
from wardenframe.operators.validation import VALID_SEVERITIES

DOCUMENT_FIELDS = ("record_id", "entity", "final_assessment", "bayesian", "rule_engine", "ml_evidence")


def _pick(df: DataFrame, names: Mapping[str, str], default: Column) -> Column:
    """Struct of the named columns; an absent one gets the default."""
    return F.struct(*[(F.col(c) if c in df.columns else default).alias(n) for n, c in names.items()])


def _same(names: Sequence[str]) -> dict[str, str]:
    return {n: n for n in names}


def claims_document(df: DataFrame) -> DataFrame:
    """Claims document of every record of the final claims table."""
    blank, none = F.lit(""), F.lit(None).cast("double")
    text = {n: F.coalesce(F.col(n).cast("string"), blank) if n in df.columns else blank for n in ("evidence_types", "evidence_features", "evidence_details", "evidence_summary")}
    return df.select(
        F.struct(F.col("plan_id").cast("string").alias("plan_id"), F.col("issuer_id").cast("string").alias("issuer_id")).alias("record_id"),
        _pick(df, _same(("state", "issuer_name", "plan_type", "metal_level", "exchange_type", "individual_or_shop")), blank).alias("entity"),
        F.struct(
            (F.col("final_anomaly") == 1).alias("anomaly"), F.col("final_severity").alias("severity"),
            F.col("anomaly_signal_count").alias("signal_count"), F.col("anomaly_signals").alias("signals"), none.alias("risk_score"),
        ).alias("final_assessment"),
        F.struct(
            (F.col("bayesian_anomaly") == 1).alias("anomaly"),
            *[(F.col(c) if c in df.columns else none).alias(n) for n, c in (("score", "gaussian_score"), ("probability", "bayesian_probability"), ("threshold", "bayesian_threshold"))],
        ).alias("bayesian"),
        F.struct(
            (F.col("rule_anomaly") == 1).alias("anomaly"), "rule_count", "rule_name", F.col("rule_reason").alias("reason"), F.col("rule_severity").alias("severity")
        ).alias("rule_engine"),
        F.struct(
            "evidence_count", F.col("evidence_severity").alias("severity"), text["evidence_types"].alias("types"), text["evidence_features"].alias("features"),
            text["evidence_details"].alias("details"), text["evidence_summary"].alias("summary"),
        ).alias("ml_evidence"),
    )


def authorization_document(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Authorization document; expects rule texts, model texts, flags and risk on the row."""
    none = F.lit(None).cast("string")
    probability = F.col("bayesian_anomaly_probability")
    return df.select(
        _pick(df, _same(("authorization_id", "reference_number")), none).alias("record_id"),
        _pick(df, _same(("patient_id", "provider_id", "payer_id", "authorization_type", "service_code", "service_description", "approval_status")), none).alias("entity"),
        F.struct(
            (F.col("final_anomaly_flag") == 1).alias("anomaly"), F.col("risk_level").alias("severity"), F.col("risk_score").cast("double").alias("risk_score"), "signal_count", "signals"
        ).alias("final_assessment"),
        F.struct(
            (F.col("bayesian_anomaly_flag") == 1).alias("anomaly"), F.round(probability * 100, 6).alias("score"), F.round(probability, 6).alias("probability"), F.lit(threshold).alias("threshold")
        ).alias("bayesian"),
        F.struct(
            (F.col("rule_anomaly_flag") == 1).alias("anomaly"), F.col("rule_anomaly_count").alias("rule_count"), "rule_name", F.col("rule_reason").alias("reason"), F.col("rule_severity").alias("severity")
        ).alias("rule_engine"),
        F.struct(*[F.col(f"ml_evidence_{n}").alias(n if n != "count" else "evidence_count") for n in ("count", "severity", "types", "features", "details", "summary")]).alias("ml_evidence"),
    )


def pharmacy_document(df: DataFrame) -> DataFrame:
    """Pharmacy document: detection, evidence by kind, context, SLA and explanation. The model is that of the column ``ml_model``, where there is one."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in (
        "claim_volume_change", "fill_volume_change", "days_supply_change", "drug_cost_change", "beneficiary_change", "cost_per_claim_change"
    )}
    return df.select(
        F.lit("pharmacy").alias("dataset_type"),
        F.col("npi").cast("string").alias("record_id"),
        F.struct("final_anomaly", "final_severity", "final_risk_score", "rule_anomaly", "ml_anomaly", "behavior_anomaly").alias("detection_summary"),
        F.struct("rule_anomaly", F.col("rule_severity").alias("severity"), F.col("rule_reason").alias("reason")).alias("rule_based_evidence"),
        F.struct((F.col("ml_model") if "ml_model" in df.columns else F.lit("Isolation Forest")).alias("model"), F.col("ml_anomaly").alias("is_anomaly"), F.col("ml_anomaly_score").alias("anomaly_score")).alias("ml_based_evidence"),
        F.struct(*[v.alias(c) for c, v in finite.items()]).alias("behavior_based_evidence"),
        F.struct("data_year", "npi", "brand", "tot_clms", "tot_30day_fills", "tot_day_suply", "tot_drug_cst", "tot_benes").alias("record_context"),
        F.struct(
            F.col("sla_status").alias("status"), F.col("sla_breach_probability").alias("breach_probability"), "workload_risk", "volume_risk", "ml_risk", "quality_risk"
        ).alias("sla"),
        F.struct("detection_source", F.col("explanation").alias("reason")).alias("explanation"),
    )


def prescriber_document(df: DataFrame, record_id: str, causes: str = "causes") -> DataFrame:
    """Compact prescriber document with detection sources, causes and a context text."""
    sentence = F.transform(causes, lambda c: F.concat(
        F.lit("Bayesian evidence indicates "), c["cause"], F.lit(" with probability "), F.format_string("%.4f", c["probability_given_anomaly"]), F.lit(".")
    ))
    breach = F.when(flag(F.col("sla_risk")), F.concat(
        F.lit("SLA processing risk is elevated with estimated breach probability "), F.format_string("%.4f", F.col("breach_probability")), F.lit(".")
    ))
    context = F.concat_ws(" ", F.transform("root_causes", lambda c: c["description"]), sentence, breach)
    return df.select(
        F.col(record_id).cast("string").alias("record_id"),
        "anomaly_detected",
        F.struct(
            F.col("rule_anomaly").alias("rule_based"), F.col("isolation_anomaly").alias("isolation_forest"), F.col("cluster_anomaly").alias("clustering"),
            F.col("behavior_anomaly").alias("behavioral"), (F.size(causes) > 0).alias("bayesian"),
        ).alias("detection_sources"),
        F.round("isolation_score", 6).alias("ml_anomaly_score"),
        F.col("root_causes").alias("rule_based_root_causes"),
        F.transform(causes, lambda c: F.struct(c["cause"].alias("cause"), c["probability_given_anomaly"].alias("probability_given_anomaly"), c["baseline_probability"].alias("baseline_probability"), c["bayesian_lift"].alias("bayesian_lift"))).alias("bayesian_probable_root_causes"),
        context.alias("context_for_rag"),
    )


# ---------------------------------------------------------------- claim-level fusion results

# Rules that only indicate risk and are no hard violation.
RISK_ONLY_RULES = (
    "RULE_015_PRIOR_AUTH_MISMATCH", "RULE_016_MEMBER_PROVIDER_STATE_MISMATCH", "RULE_017_PROVIDER_NOT_VERIFIED", "RULE_018_OUT_OF_NETWORK",
    "RULE_019_HIGH_SERVICE_INTENSITY", "RULE_020_HIGH_PROCESSING_TIME", "RULE_021_PREPROCESSING_ANOMALY",
)


def assessed_severity(raw: Column, anomaly: Column) -> Column:
    """NORMAL unless anomalous; an unknown or missing severity of an anomaly is LOW."""
    text = F.upper(F.trim(raw))
    return F.when(~flag(anomaly), "NORMAL").when(flag(text.isin(*VALID_SEVERITIES)), text).otherwise("LOW")


def hard_rules(triggered: Column) -> Column:
    """Rule names of a ``|`` list without the risk-only ones."""
    parts = F.transform(F.split(F.coalesce(triggered, F.lit("")), r"\|"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (s != "") & ~s.isin(*RISK_ONLY_RULES))


def claim_fusion_document(df: DataFrame) -> DataFrame:
    """Claim document from fusion columns (anomaly flag, source, type, severity, triggered rules, model scores)."""
    anomaly = parse_bool("final_anomaly_flag", TRUE_WORDS_WITH_DETECTED)
    model = parse_bool("ml_anomaly_flag", TRUE_WORDS_WITH_DETECTED)
    source, kind = F.upper(F.coalesce("detection_source", F.lit("NONE"))), F.coalesce("final_anomaly_type", F.lit("Normal"))
    signals = F.array_distinct(F.array_compact(F.array(
        F.when(anomaly & source.isin("ML_ONLY", "ML_AND_RULE"), "ML_ANOMALY"),
        F.when(anomaly & source.isin("RULE_ONLY", "ML_AND_RULE"), "RULE_ANOMALY"),
        F.when(anomaly & (kind != "Normal") & (kind != ""), kind),
    )))
    rules = hard_rules(F.col("triggered_rules"))
    n = F.size(rules)
    severity = assessed_severity(F.col("final_severity"), anomaly)
    score, scaled = F.coalesce("ml_anomaly_score", F.lit(0.0)), F.coalesce("ml_normalized_score", F.lit(0.0))
    details = F.concat(F.lit("ML anomaly score: "), F.format_string("%.6f", score), F.lit("; normalized score: "), F.format_string("%.6f", scaled))
    blank = F.lit("")
    return df.select(
        F.struct(*[c for c in ("claim_id", "member_id", "provider_id") if c in df.columns]).alias("record_id"),
        F.struct(
            anomaly.alias("anomaly"), severity.alias("severity"), F.when(anomaly, F.size(signals)).otherwise(0).alias("signal_count"),
            F.when(~anomaly, "None").when(F.size(signals) > 0, F.array_join(signals, "|")).otherwise("Anomaly detected").alias("signals"),
        ).alias("final_assessment"),
        F.struct(model.alias("anomaly"), score.alias("score"), scaled.alias("probability"), F.lit(0.0).alias("threshold")).alias("bayesian"),
        F.struct(
            (n > 0).alias("anomaly"), n.alias("rule_count"), F.when(n > 0, F.try_element_at(rules, F.lit(1))).otherwise("NONE").alias("rule_name"),
            F.when(n > 0, F.array_join(rules, "; ")).otherwise("No rule violation detected").alias("reason"),
            F.when(n > 0, assessed_severity(F.col("rule_severity"), F.lit(True))).otherwise("NONE").alias("severity"),
        ).alias("rule_engine"),
        F.struct(
            model.cast("int").alias("evidence_count"), F.when(model, assessed_severity(F.col("final_severity"), F.lit(True))).otherwise(blank).alias("severity"),
            F.when(model, kind).otherwise(blank).alias("types"), blank.alias("features"), F.when(model, details).otherwise(blank).alias("details"),
            F.when(model, "Machine-learning anomaly detection identified this claim as anomalous.").otherwise(blank).alias("summary"),
        ).alias("ml_evidence"),
    )


# ---------------------------------------------------------------- canonical form

_IDENTITY = {
    "claims": ("plan_id", "issuer_id"),
    "pharmacy": ("plan_id", "issuer_id"),
    "authorization": ("authorization_id", "reference_number"),
}


def _identity(docs: DataFrame, dataset: str) -> Column:
    """Joined plan and issuer, or the first of authorization and reference number; 'unknown' without any."""
    have = docs.schema["record_id"].dataType.names
    parts = [F.nullif(F.col(f"record_id.{k}").cast("string"), F.lit("")) for k in _IDENTITY[dataset] if k in have]
    if dataset == "authorization":
        return F.coalesce(*parts, F.lit("unknown"))
    return F.coalesce(F.nullif(F.concat_ws("_", *parts), F.lit("")), F.lit("unknown"))


def _context(docs: DataFrame, extra: Column | None) -> Column:
    """Map of every identifier and entity value that is present."""
    entries = []
    for part in ("record_id", "entity"):
        if part in docs.columns:
            entries += [F.struct(F.lit(n).alias("key"), F.col(f"{part}.{n}").cast("string").alias("value")) for n in docs.schema[part].dataType.names]
    if extra is not None:
        entries.append(F.struct(F.lit("context_for_rag").alias("key"), F.nullif(extra, F.lit("")).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def canonical_record(docs: DataFrame, dataset: str) -> DataFrame:
    """The one record shape that retrieval and explanation read, from a document of any data set."""
    context = F.col("context_for_rag") if "context_for_rag" in docs.columns else None
    fa, rules, ml, bayes = F.col("final_assessment"), F.col("rule_engine"), F.col("ml_evidence"), F.col("bayesian")
    ml_names = docs.schema["ml_evidence"].dataType.names

    def m(name: str, kind: str = "string") -> Column:
        return ml[name] if name in ml_names else F.lit(None).cast(kind)

    model_flag = F.coalesce(m("anomaly", "boolean"), F.lit(False))
    risk = fa["risk_score"] if "risk_score" in docs.schema["final_assessment"].dataType.names else F.lit(None).cast("double")
    names = F.filter(F.transform(F.split(rules["rule_name"], ";"), lambda s: F.trim(s)), lambda s: s != "")
    evidence = F.when(flag(rules["anomaly"]), F.transform(names, lambda n: F.struct(
        n.alias("rule_name"), F.lit("ANOMALY").alias("status"), rules["reason"].alias("reason"), rules["severity"].alias("severity")
    ))).otherwise(F.array().cast("array<struct<rule_name:string,status:string,reason:string,severity:string>>"))
    behaviour_type = "array<struct<type:string,detected:boolean,description:string>>"
    behaviour = F.array().cast(behaviour_type)
    if dataset == "pharmacy":
        described = F.coalesce(context, F.lit("Behavioral anomaly detected.")) if context is not None else F.lit("Behavioral anomaly detected.")
        item = F.array(F.struct(F.lit("behavioral").alias("type"), F.lit(True).alias("detected"), described.alias("description")))
        behaviour = F.when(F.contains(fa["signals"], F.lit("Behavioral")), item).otherwise(behaviour)
    return docs.select(
        F.lit(dataset).alias("dataset_type"),
        _identity(docs, dataset).alias("record_id"),
        F.struct(
            fa["anomaly"].alias("final_anomaly"), fa["severity"].alias("final_severity"), risk.alias("final_risk_score"),
            *[F.lit(None).cast("double").alias(n) for n in ("rule_risk_score", "ml_risk_score", "cluster_risk_score")],
            bayes["probability"].alias("bayesian_probability"), bayes["anomaly"].alias("bayesian_anomaly"), m("score", "double").alias("ml_anomaly_score"),
            rules["anomaly"].alias("rule_anomaly"), model_flag.alias("ml_anomaly"), fa["signals"].alias("anomaly_type"),
        ).alias("detection_summary"),
        evidence.alias("rule_based_evidence"),
        F.struct(
            m("model").alias("model"), model_flag.alias("is_anomaly"), m("score", "double").alias("anomaly_score"), F.array().cast("array<string>").alias("contributing_features"),
            F.coalesce(m("evidence_count", "int"), F.lit(0)).alias("evidence_count"), m("severity").alias("severity"), m("types").alias("types"), m("details").alias("details"), m("summary").alias("summary"),
        ).alias("ml_based_evidence"),
        F.struct(bayes["anomaly"].alias("anomaly"), bayes["score"].alias("score"), bayes["probability"].alias("probability"), bayes["threshold"].alias("threshold")).alias("bayesian_evidence"),
        behaviour.alias("behavioral_evidence"),
        _context(docs, context).alias("record_context"),
        (context if context is not None else F.lit(None).cast("string")).alias("source_explanation"),
        F.lit(None).cast("string").alias("sla"),
    )


def normalise_record(records: DataFrame) -> DataFrame:
    """Missing lists become empty and the model evidence is cut to its four core fields (NULL stays NULL)."""
    ml = F.col("ml_based_evidence")
    core = F.struct(ml["model"].alias("model"), ml["is_anomaly"].alias("is_anomaly"), ml["anomaly_score"].alias("anomaly_score"),
                    F.coalesce(ml["contributing_features"], F.array().cast("array<string>")).alias("contributing_features"))
    rules = records.schema["rule_based_evidence"].dataType.simpleString()
    return records.withColumns({
        "rule_based_evidence": F.coalesce("rule_based_evidence", F.array().cast(rules)),
        "record_context": F.coalesce("record_context", F.create_map().cast("map<string,string>")),
        "ml_based_evidence": F.when(ml.isNotNull(), core),
    })


def evidence_summary(records: DataFrame) -> DataFrame:
    """What later steps ask of a record: flags, rule names and features."""
    d, ml = F.col("detection_summary"), F.col("ml_based_evidence")
    return records.select(
        "record_id", "dataset_type", d["rule_anomaly"].alias("rule_anomaly"), d["ml_anomaly"].alias("ml_anomaly"), ml.isNotNull().alias("ml_evidence_available"),
        F.filter(F.transform("rule_based_evidence", lambda r: r["rule_name"]), lambda n: n.isNotNull() & (n != "")).alias("rule_names"),
        F.coalesce(ml["contributing_features"], F.array().cast("array<string>")).alias("ml_features"),
    )


# ---------------------------------------------------------------- anomaly store

# Texts of stored model findings.
STORE_CAUSE = "Provider behaviour deviates from peer baseline."
STORE_FIX = "Review record against provider history."


def store_rows(scored: DataFrame, record_id: Column, is_anomaly: Column, source_dataset: str = "AUTHORIZATION") -> DataFrame:
    """Anomalous scored records as store rows; the affected field is the farthest-off feature."""
    top = F.try_element_at(F.col("contributing"), F.lit(1))
    message = F.concat(
        top["feature"], F.lit(" is "), F.replace(top["direction"], F.lit("_"), F.lit(" ")), F.lit(" (value="), top["value"].cast("string"),
        F.lit(", deviation="), top["deviation_score"].cast("string"), F.lit("σ)"),
    )
    return scored.where(flag(is_anomaly)).select(
        F.lit(source_dataset).alias("source_dataset"), record_id.alias("record_id"), F.lit("SLA_PROCESSING_SPIKE").alias("anomaly_type"), "severity", F.lit("OPEN").alias("status"),
        F.coalesce(top["feature"], F.lit("multiple_fields")).alias("affected_field"), F.coalesce(message, F.lit("Unusual authorization pattern")).alias("error_message"),
        F.lit(STORE_CAUSE).alias("likely_cause"), F.lit(STORE_FIX).alias("recommended_fix"),
    )
