"""Row validation with quarantine, issue reports and integrity checks between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag, is_blank, strict_date, to_number, wide_to_rows, with_scalars
from wardenframe.operators.contracts import Contract


def _error(kind: str, column: str, message: str, bad: Column) -> Column:
    return F.when(
        flag(bad),
        F.struct(F.lit(kind).alias("type"), F.lit("ERROR").alias("severity"), F.lit(column).alias("column"), F.lit(message).alias("message")),
    )


def row_checks(contract: Contract, columns: Sequence[str]) -> list[Column]:
    """Error structs (NULL when fine) of every check that looks at one row only."""
    checks: list[Column] = []
    mandatory = set(contract.mandatory)
    for c in contract.required:
        if c not in columns:
            continue
        empty = is_blank(c) if c in mandatory else F.lit(False)
        if c in mandatory:
            checks.append(_error("completeness", c, "Missing/blank values", empty))
        kind = contract.types.get(c, "string")
        if kind == "date":
            checks.append(_error("type", c, f"Invalid {kind} value", strict_date(c).isNull() & ~empty))
        elif kind in ("float", "integer"):
            checks.append(_error("type", c, f"Invalid {kind} value", to_number(c).isNull() & ~empty))
    for c, (trigger, values) in contract.conditional.items():
        if c in columns and trigger in columns:
            text = f"Missing/blank value required when {trigger} in {list(values)}"
            checks.append(_error("completeness", c, text, F.col(trigger).isin(*values) & is_blank(c)))
    for c, values in contract.allowed.items():
        if c in columns:
            checks.append(_error("domain", c, f"Allowed values: {list(values)}", F.col(c).isNotNull() & ~F.col(c).isin(*values)))
    for c in contract.non_negative:
        if c in columns:
            checks.append(_error("range", c, "Negative value not allowed", to_number(c) < 0))
    return checks


def mark_copies(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Flag every row whose (fully present) key occurs more than once.

    Counts are pre-aggregated and joined back. Unlike a window, a key that holds a large share of
    the rows is then split by the skew-join rule instead of landing in one task.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    repeated = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    return df.join(repeated, list(keys), "left").select(*df.columns, F.col("_copies").isNotNull().alias(name))


def tag_errors(df: DataFrame, contract: Contract, within: Sequence[str] = ()) -> DataFrame:
    """Add ``errors``: one struct per failed check. An empty array means the row is valid.

    Unique columns are unique among the rows that agree in the columns ``within`` (none: the whole table).
    """
    columns = df.columns
    checks = row_checks(contract, columns)
    marked = df
    for c in contract.unique:
        if c in columns:
            marked = mark_copies(marked, [*within, c], f"_copied_{c}")
            checks.append(_error("duplicate", c, "Duplicate value", F.col(f"_copied_{c}")))
    return marked.select(*columns, F.array_compact(F.array(*checks)).alias("errors"))


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows of a tagged table."""
    return tagged.where(F.size("errors") == 0).drop("errors"), tagged.where(F.size("errors") > 0)


def header_issues(columns: Sequence[str], contract: Contract) -> list[tuple[str, str, str, str]]:
    """Missing columns are errors, unknown ones are warnings."""
    missing = [("schema", "ERROR", c, "Missing required column") for c in contract.required if c not in columns]
    return missing + [("schema", "WARNING", c, "Unexpected column") for c in columns if c not in contract.required]


def issue_report(tagged: DataFrame, contract: Contract) -> DataFrame:
    """One row per (type, severity, column, message) with the number of rows hit."""
    found = tagged.select(F.explode("errors").alias("e")).groupBy("e.type", "e.severity", "e.column", "e.message").agg(
        F.count(F.lit(1)).alias("rows")
    )
    header = header_issues([c for c in tagged.columns if c != "errors"], contract)
    if not header:
        return found
    extra = tagged.sparkSession.createDataFrame([(*h, None) for h in header], "type string, severity string, column string, message string, rows long")
    return found.unionByName(extra)


def summary(tagged: DataFrame) -> DataFrame:
    """Totals and PASS / FAIL of one validated table."""
    return tagged.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.size("errors") == 0).alias("valid_records"),
        F.count_if(F.size("errors") > 0).alias("invalid_records"),
        F.when(F.count_if(F.size("errors") > 0) > 0, "FAIL").otherwise("PASS").alias("status"),
    )


def error_rollup(tagged: DataFrame, file_column: str) -> DataFrame:
    """Error counts per (file, type), per file and overall in one pass."""
    errors = tagged.select(F.col(file_column).alias("file"), F.explode("errors.type").alias("type"))
    rolled = errors.rollup("file", "type").agg(F.count(F.lit(1)).alias("errors"), F.grouping_id().alias("level"))
    level = F.when(F.col("level") == 0, "file_type").when(F.col("level") == 1, "file").otherwise("run")
    return rolled.select(level.alias("level"), "file", "type", "errors")


def run_summary(tagged: DataFrame, file_column: str) -> DataFrame:
    """One line for a whole run over many files."""
    files = tagged.groupBy(file_column).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid")
    )
    return files.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.count_if(F.col("invalid") > 0).alias("files_failed"),
        F.sum("rows").alias("total_rows"),
        F.sum("valid").alias("total_valid_rows"),
        F.sum("invalid").alias("total_invalid_rows"),
        F.when(F.count_if(F.col("invalid") > 0) > 0, "issues_found").otherwise("pass").alias("overall_status"),
    )


def anomaly_rows(tagged: DataFrame, contract: Contract, record_id: str, source_dataset: str, limit: int | None = None) -> DataFrame:
    """Invalid rows as anomaly-store rows.

    The affected field is the first column with an issue in this table whose value is blank text; its
    message is the last kind of issue found for that column. ``limit`` keeps that many rows in record
    order, for callers that want a bounded upload.
    """
    columns = [c for c in contract.required if c in tagged.columns]
    kinds = ("completeness", "type", "domain", "range", "duplicate")

    def message(column: str, kind: str) -> Column:
        hits = F.filter("errors", lambda e: (e["column"] == column) & (e["type"] == kind))
        return F.max(F.array_max(F.transform(hits, lambda e: e["message"])))

    seen = tagged.agg(*[F.array_compact(F.array(*[message(c, k) for k in kinds])).alias(c) for c in columns])
    invalid = with_scalars(tagged.where(F.size("errors") > 0), seen, "_issue")
    choices = [
        F.when((F.trim(F.col(c)) == "") & (F.size(f"_issue.{c}") > 0), F.struct(F.lit(c).alias("field"), F.element_at(f"_issue.{c}", -1).alias("message")))
        for c in columns
    ]
    fallback = F.struct(F.lit("multiple_fields").alias("field"), F.lit("Validation rule failed").alias("message"))
    rows = invalid.withColumn("_a", F.coalesce(*choices, fallback)).select(
        F.lit(source_dataset).alias("source_dataset"),
        F.col(record_id).alias("record_id"),
        F.lit("MISSING_FIELD").alias("anomaly_type"),
        F.lit("HIGH").alias("severity"),
        F.lit("OPEN").alias("status"),
        F.col("_a.field").alias("affected_field"),
        F.col("_a.message").alias("error_message"),
        F.lit("Data quality issue in source file.").alias("likely_cause"),
        F.lit("Correct the field in the source system and re-upload.").alias("recommended_fix"),
    )
    return rows if limit is None else rows.orderBy("record_id").limit(limit)


# ---------------------------------------------------------------- column findings

def null_findings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count and share of every column, in one pass."""
    row = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__null_count") for c in columns],
        *[F.round(F.count_if(F.col(c).isNull()) * 100.0 / F.count(F.lit(1)), 4).alias(f"{c}__null_percent") for c in columns],
    )
    return wide_to_rows(row, columns, ("null_count", "null_percent"), {"null_count": "long", "null_percent": "double"})


def negative_findings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c) < 0).alias(f"{c}__negative_count") for c in columns])
    return wide_to_rows(row, columns, ("negative_count",), {"negative_count": "long"})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows are part of a full-row duplicate, and what share that is."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("surplus_rows"),
        F.round(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)) * 100.0 / F.sum("_n"), 4).alias("duplicate_percentage"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str], examples: int = 10) -> DataFrame:
    """The most repeated keys as examples (a top-k report), with the number of repeated keys and rows."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    totals = repeated.agg(F.count(F.lit(1)).alias("repeated_keys"), F.sum("copies").alias("repeated_rows"))
    top = repeated.orderBy(F.desc("copies"), *keys).limit(examples)
    return with_scalars(top, totals, "_t").select(*keys, "copies", "_t.repeated_keys", "_t.repeated_rows")


def compare_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of keys on both sides, only left and only right."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("in_both"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
    )


def fused_integrity(df: DataFrame, final: str, parts: Mapping[str, Column], expected_total: int | None = None) -> DataFrame:
    """Counts of a fused table and whether they can be right: no signal may outnumber the final flag."""
    row = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col(final)).alias("final_anomalies"),
        *[F.count_if(flag(p)).alias(name) for name, p in parts.items()],
    )
    sound = reduce(lambda a, b: a & b, [F.col("final_anomalies") >= F.col(n) for n in parts])
    if expected_total is not None:
        sound = sound & (F.col("total_records") == expected_total)
    return row.select(
        "*",
        F.round(F.col("final_anomalies") * 100.0 / F.col("total_records"), 4).alias("final_anomaly_percentage"),
        F.when(sound, "PASSED").otherwise("FAILED").alias("status"),
    )


# ---------------------------------------------------------------- anomaly record conformance

# Fixed values.
SUPPORTED_DATASETS = ("authorization", "pharmacy", "claims")
REQUIRED_RECORD_FIELDS = ("dataset_type", "detection_summary", "ml_based_evidence", "record_context", "record_id", "rule_based_evidence")
REQUIRED_DETECTION_FIELDS = ("final_anomaly", "final_risk_score", "final_severity", "ml_anomaly", "rule_anomaly")
VALID_SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def json_record_errors(record: Column) -> Column:
    """Array of problems of one anomaly record given as JSON text."""
    doc = F.try_parse_json(record)

    def has(path: str) -> Column:
        return F.array_contains(F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")), path)

    def shape(path: str) -> Column:
        """First character of the JSON value: '{' object, '[' array, else a scalar; NULL when JSON null."""
        return F.substring(F.get_json_object(record, f"$.{path}"), 1, 1)

    missing = [F.when(~has(f), F.lit(f"missing required field '{f}'")) for f in REQUIRED_RECORD_FIELDS]
    dataset = F.try_variant_get(doc, "$.dataset_type", "string")
    rid = F.try_variant_get(doc, "$.record_id", "string")
    detection = F.get_json_object(record, "$.detection_summary")
    detection_keys = F.coalesce(F.json_object_keys(detection), F.array().cast("array<string>"))
    is_object = shape("detection_summary").eqNullSafe("{")
    content = [
        F.when(~flag(dataset.isin(*SUPPORTED_DATASETS)), F.concat(F.lit("unsupported dataset_type '"), F.coalesce(dataset, F.lit("null")), F.lit("'"))),
        F.when(is_blank(rid), F.lit("record_id must be a non-empty string")),
        F.when(~is_object, F.lit("detection_summary must be an object")),
        *[
            F.when(is_object & ~F.array_contains(detection_keys, f), F.lit(f"detection_summary missing '{f}'"))
            for f in REQUIRED_DETECTION_FIELDS
        ],
        F.when(~shape("rule_based_evidence").eqNullSafe("["), F.lit("rule_based_evidence must be an array")),
        F.when(~F.coalesce(shape("ml_based_evidence"), F.lit("{")).eqNullSafe("{"), F.lit("ml_based_evidence must be an object or null")),
        F.when(~shape("record_context").eqNullSafe("{"), F.lit("record_context must be an object")),
        F.when(~F.coalesce(shape("sla"), F.lit("{")).eqNullSafe("{"), F.lit("sla must be an object or null")),
    ]
    absent = F.array_compact(F.array(*missing))
    return (
        F.when(doc.isNull(), F.array(F.lit("record must be an object")))
        .when(F.size(absent) > 0, absent)
        .otherwise(F.array_compact(F.array(*content)))
    )


def output_conformance(df: DataFrame, anomaly: str, severity: str, signals: str) -> DataFrame:
    """Rows that break the output rules, counted by rule."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.col(anomaly) & (F.col(severity) != "NORMAL")).alias("normal_with_severity"),
        F.count_if(F.col(anomaly) & ~F.col(severity).isin(*VALID_SEVERITIES)).alias("anomaly_without_severity"),
        F.count_if(~F.col(anomaly) & (F.col(signals) != 0)).alias("normal_with_signals"),
    )


def feature_validation(df: DataFrame, rates: Sequence[str], raws: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Clean rates outside 0..1, raw ratios outside 0..1 and raised consistency flags per column, in one pass."""
    checks = {c: ~F.col(c).between(0, 1) for c in (*rates, *raws)} | {c: F.col(c) == 1 for c in flags}
    kinds = {c: "clean_rate" for c in rates} | {c: "raw_ratio" for c in raws} | {c: "consistency" for c in flags}
    names = list(checks)
    row = df.agg(
        *[F.count_if(flag(p)).alias(f"{c}__hits") for c, p in checks.items()],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__missing") for c in names],
    )
    rows = wide_to_rows(row, names, ("hits", "missing"), {"hits": "long", "missing": "long"})
    kind = F.create_map(*[F.lit(x) for c in names for x in (c, kinds[c])])
    return rows.select("column_name", kind[F.col("column_name")].alias("kind"), "hits", "missing")


def most_missing(df: DataFrame, columns: Sequence[str], top: int = 15) -> DataFrame:
    """The columns with most NULLs (top-k report)."""
    return null_findings(df, columns).where("null_count > 0").orderBy(F.desc("null_count"), "column_name").limit(top)
