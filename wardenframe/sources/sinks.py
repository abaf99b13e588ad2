"""File sinks. Every write is one distributed job; nothing is gathered first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardenframe.operators import validation
from wardenframe.operators.contracts import Contract
from wardenframe.operators.serving import first_per_key, new_records


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; white space in cells is kept."""
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


def write_by_year(df: DataFrame, path: str, column: str = "data_year") -> None:
    """ZSTD Parquet, one folder per year, so that later reads prune to the years they need."""
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)


class TornSinkError(RuntimeError):
    """What is read back from a sink is not what was written to it."""


def _document(df: DataFrame) -> DataFrame:
    """Each record as the line that stands for it in a file."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def _measured() -> list[Column]:
    """Lines and a sum of their hashes, the same in any order."""
    return [F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum")]


def write_documents(df: DataFrame, path: str, compression: str = "none") -> dict[str, int]:
    """Nested records as JSON lines, written in parallel; what the write counted, after it has been read back."""
    seen = Observation()
    _document(df).observe(seen, *_measured()).write.option("compression", compression).text(path)
    written = {k: int(v) for k, v in seen.get.items()}
    df.sparkSession.createDataFrame([(written["records"], str(written["checksum"]))], "records long, checksum string").coalesce(1).write.json(f"{path.rstrip('/')}.counts")
    verify_documents(df.sparkSession, path)
    return written


def verify_documents(spark: SparkSession, path: str) -> None:
    """Compare the lines of a document sink with the counts that its write has left beside it."""
    noted = spark.read.schema("records long, checksum string").json(f"{path.rstrip('/')}.counts").first()
    found = spark.read.text(path).agg(*_measured()).first()
    if (found["records"], str(int(found["checksum"]))) != (noted["records"], noted["checksum"]):
        raise TornSinkError(f"{path} holds {found['records']} records, {noted['records']} were written, or others than these")


def write_anomalies(df: DataFrame, path: str, flag: str = "anomaly_detected", compression: str = "none") -> dict[str, int]:
    """Only the anomalous records."""
    return write_documents(df.where(F.col(flag)), path, compression)


def write_validated(tagged: DataFrame, contract: Contract, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows, quarantined rows and the issue report under one folder.

    The rows are tagged and written once, split by outcome; the report is counted from the quarantined
    part of what was written.
    """
    spark = tagged.sparkSession
    outcome = F.when(F.size("errors") == 0, "valid").otherwise("invalid")
    tagged.withColumn("outcome", outcome).write.partitionBy("outcome").parquet(f"{path}/rows")
    rows = spark.read.schema(tagged.withColumn("outcome", outcome).schema).parquet(f"{path}/rows")
    valid = rows.where("outcome = 'valid'").drop("errors", "outcome")
    invalid = rows.where("outcome = 'invalid'").drop("outcome")
    report = validation.issue_report(invalid, contract)
    report.write.json(f"{path}/report")
    return valid, invalid, spark.read.schema(report.schema).json(f"{path}/report")


def append_new(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Append the records whose key the store does not hold yet, one per key: the first by ``order``, then by all columns."""
    spark = df.sparkSession
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    fresh = first_per_key(df, keys, rest) if rest else df.distinct()
    try:
        store = spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no store yet
            raise
        store = None
    known = None if store is None else store.select(*keys).distinct()
    fresh = fresh if known is None else new_records(fresh, known, keys)
    fresh.write.mode("append").parquet(path)
