"""Stream sinks that a replayed or torn batch cannot harm: rows by outcome, an issue report, and a ledger of batches.

A batch writes its rows once, into a folder of its own number that an earlier attempt's files leave, reads them back
against what was counted while they were written, derives the report from the written rows, and enters itself in
the ledger last. Readers see the batches of the ledger only, so a batch appears in all sinks at once or in none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER_SCHEMA = "batch_id long, stream string, rows long, valid long, invalid long, checksum decimal(38,0)"
#: Folder names of a batch in the sinks, and with it a column of what is read back.
_BATCH = "batch_id"


def row_checksum(columns: list[str]) -> Column:
    """Sum of row hashes: the same for the same rows in any order and partitioning."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")


def _read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A folder that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch that is complete in all sinks."""
    return _read(spark, f"{root}/ledger", LEDGER_SCHEMA).drop("entry")


def _committed(spark: SparkSession, root: str, part: str) -> DataFrame:
    try:
        rows = spark.read.parquet(f"{root}/{part}")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"no batch has been written to {root}") from error
    return rows.join(read_ledger(spark, root).select(_BATCH), _BATCH, "left_semi")


def committed_rows(spark: SparkSession, root: str, outcome: str | None = None) -> DataFrame:
    """Rows (of one outcome) of the batches that the ledger names, with their ``batch_id``."""
    rows = _committed(spark, root, "rows")
    return rows.where(F.col("outcome") == outcome) if outcome else rows


def committed_issues(spark: SparkSession, root: str) -> DataFrame:
    """Number of rows by batch, error type and column, of the batches that the ledger names."""
    return _committed(spark, root, "issues")


def batch_writer(root: str, stream: str, after_rows: Callable[[int], None] | None = None, after_ledger: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` that writes quarantined rows (``errors``, ``outcome`` and others) as the module says.

    ``stream`` names the stream whose batch numbers these are. The two callables run between the steps.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = read_ledger(spark, root)
        if not ledger.where(F.col(_BATCH) == number).isEmpty():
            # Complete before; only the stream's own note of it was lost. It runs once more, so that its state is committed, and writes nothing.
            batch.write.format("noop").mode("overwrite").save()
            return
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("outcome") == "valid").alias("valid"), row_checksum(batch.columns).alias("checksum")]
        seen = Observation()
        path = f"{root}/rows/{_BATCH}={number}"
        batch.observe(seen, *counts).write.mode("overwrite").partitionBy("outcome").parquet(path)
        found = dict(seen.get)
        written = _read(spark, path, batch.schema)
        again = written.agg(*counts).first().asDict()
        if again != found:
            raise RuntimeError(f"batch {number}: {found} were written, {again} were read back")
        if not found["rows"]:
            return  # a batch that only moved the watermark
        if after_rows:
            after_rows(number)
        issues = written.where("outcome = 'invalid'").select(F.explode("errors").alias("e")).groupBy("e.type", "e.column").agg(F.count(F.lit(1)).alias("rows"))
        issues.write.mode("overwrite").parquet(f"{root}/issues/{_BATCH}={number}")
        entry = [(number, stream, found["rows"], found["valid"], found["rows"] - found["valid"], found["checksum"])]
        spark.createDataFrame(entry, LEDGER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/entry={number}")
        if after_ledger:
            after_ledger(number)
    return write


def drain_to_sinks(tagged: DataFrame, root: str, checkpoint: str, **steps: Callable[[int], None]) -> None:
    """Process everything that is available into the sinks under ``root``.

    Batch numbers belong to the checkpoint; a root that another checkpoint has written is refused, as its numbers
    would be taken for batches that are complete.
    """
    spark = tagged.sparkSession
    if _BATCH in tagged.columns:
        raise ValueError(f"the rows have a column {_BATCH} of their own")
    others = read_ledger(spark, root).where(F.col("stream") != checkpoint).select("stream").take(1)
    if others:
        raise ValueError(f"{root} holds the batches of the stream {others[0]['stream']}")
    query = tagged.writeStream.foreachBatch(batch_writer(root, checkpoint, **steps)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
