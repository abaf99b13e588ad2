"""Ingest of a landing folder, file by file: contract from the file's own header, renaming, validation, one report row each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenframe.operators.contracts import Contract, detect_contract, resolve_columns, score_contracts
from wardenframe.operators.validation import tag_errors
from wardenframe.session import materialise
from wardenframe.sources.landing import as_cells, cell_columns

TAGS = ("file", "format")
#: Files up to which what is known of each is sent to all tasks; of more files, their rows are shuffled to meet it.
FILES_SENT = 10_000


def _of_file(rows: DataFrame, known: DataFrame, files: int | None) -> DataFrame:
    """Rows of the files in ``known``, with what it says of each."""
    return rows.join(F.broadcast(known) if files is not None and files <= FILES_SENT else known, "file")


def rename_columns(landed: DataFrame, resolved: DataFrame, contract: Contract, files: int | None = None) -> DataFrame:
    """Rows of the files in ``resolved`` with the contract's column names, by each file's own mapping.

    A canonical column that no column of the file maps to is NULL. Names differ per file, so a row's cells are
    looked up by name; the mapping is one short row per file. ``files``: how many there are, if counted.
    """
    mapping = resolved.where(F.col("schema") == contract.name).groupBy(F.col("file_id").alias("file")).agg(F.map_from_entries(F.collect_list(F.struct("canonical", "column_name"))).alias("_names"))
    rows = _of_file(as_cells(landed).select(*TAGS, F.col("cells").alias("_cells")), mapping, files)
    return rows.select(*TAGS, *[F.try_element_at("_cells", F.try_element_at("_names", F.lit(c))).alias(c) for c in contract.required])


def ingest_report(landed: DataFrame, contracts: Sequence[Contract], similarity: str = "sequence") -> tuple[DataFrame, dict[str, DataFrame]]:
    """One report row per file, and per contract the tagged rows of its files under canonical names.

    Keys are unique within a file. A file that matches no contract well enough is ``UNMATCHED`` and not
    validated; a missing required column makes a file ``FAIL`` as an invalid row does, an unknown column is
    only counted.
    """
    landed = as_cells(landed)
    catalogue = cell_columns(landed)
    resolved = resolve_columns(catalogue, contracts, similarity=similarity)
    detected = materialise(detect_contract(score_contracts(catalogue, resolved, contracts)), "ingest-contracts")
    files = detected.count()
    chosen = resolved.join(detected, "file_id").where(F.col("schema") == F.col("matched_schema"))
    used = chosen.groupBy("file_id").agg(F.count_distinct("canonical").alias("mapped"))
    columns = catalogue.groupBy("file_id").agg(F.count(F.lit(1)).alias("columns"))
    tagged, counts = {}, []
    for contract in contracts:
        present = chosen.where(F.col("schema") == contract.name).groupBy(F.col("file_id").alias("file")).agg(F.collect_set("canonical").alias("_present"))
        rows = tag_errors(rename_columns(landed, chosen, contract, files), contract, within=["file"])
        # What a whole file lacks is said once in its report, not in each of its rows.
        rows = _of_file(rows, present, files).withColumn("errors", F.filter("errors", lambda e: F.array_contains("_present", e["column"]))).drop("_present")
        tagged[contract.name] = rows
        counts.append(rows.groupBy("file").agg(F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid")))
    validated = counts[0]
    for more in counts[1:]:
        validated = validated.union(more)
    sizes = F.create_map(*[x for k in contracts for x in (F.lit(k.name), F.lit(len(k.required)))])
    report = landed.groupBy(*TAGS).agg(F.count(F.lit(1)).alias("rows")).join(validated, "file", "left")
    report = report.join(detected.withColumnRenamed("file_id", "file"), "file", "left").join(used.withColumnRenamed("file_id", "file"), "file", "left").join(columns.withColumnRenamed("file_id", "file"), "file", "left")
    missing = F.try_element_at(sizes, F.col("matched_schema")) - F.col("mapped")
    status = F.when(F.col("matched_schema").isNull(), "UNMATCHED").when((missing > 0) | (F.col("invalid") > 0), "FAIL").otherwise("PASS")
    extra = F.when(F.col("matched_schema").isNotNull(), F.col("columns") - F.col("mapped"))
    return report.select(*TAGS, "rows", "valid", "invalid", "matched_schema", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), missing.alias("missing_columns"), extra.alias("unexpected_columns"), status.alias("status")), tagged
