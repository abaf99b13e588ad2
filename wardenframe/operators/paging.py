"""Pages of a long list without sorting or skipping what comes before: the list is kept in order, with a small table of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RANGE, _PLACE = "_range", "_place"
#: Bits of a row's place in `monotonically_increasing_id`.
_PLACE_BITS = 33


def _order(newest: str, key: str) -> list:
    return [F.desc(newest), F.desc(key)]


def write_pages(df: DataFrame, path: str, newest: str = "detected_at", key: str = "id", ranges: int | None = None) -> None:
    """Write the list newest first, with the key to break ties, in ranges; ``ranges`` of them at most.

    A row is found by its range and its place there, so only the number of rows before each range is counted.
    """
    dealt = df.repartitionByRange(ranges, *_order(newest, key)) if ranges else df.repartitionByRange(*_order(newest, key))
    place = F.monotonically_increasing_id()
    sorted_ = dealt.sortWithinPartitions(*_order(newest, key)).withColumn("_id", place)
    numbered = sorted_.withColumns({_RANGE: F.shiftright("_id", _PLACE_BITS), _PLACE: F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("_id")
    numbered.write.partitionBy(_RANGE).parquet(f"{path}/rows")
    spark = df.sparkSession
    rows = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    rows.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{path}/ranges")


def _ranges(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(range, rows before it, rows) in order: one entry per range."""
    out, before = [], 0
    for r in sorted(spark.read.parquet(f"{path}/ranges").collect()):
        out.append((r[_RANGE], before, r["rows"]))
        before += r["rows"]
    return out


def total_rows(spark: SparkSession, path: str) -> int:
    return sum(n for *_, n in _ranges(spark, path))


def read_page(spark: SparkSession, path: str, number: int, size: int, newest: str = "detected_at", key: str = "id") -> DataFrame:
    """Page ``number`` (from 1), read from the ranges that hold it and no others."""
    first, end = (number - 1) * size, number * size
    rows = spark.read.parquet(f"{path}/rows")
    held = [(r, first - before, end - before) for r, before, n in _ranges(spark, path) if before < end and before + n > first]
    inside = F.lit(False)
    for r, low, high in held:
        inside = inside | ((F.col(_RANGE) == r) & (F.col(_PLACE) >= low) & (F.col(_PLACE) < high))
    found = rows.where(F.col(_RANGE).isin([r for r, *_ in held])).where(inside)
    return found.drop(_RANGE, _PLACE).orderBy(*_order(newest, key)).limit(size)


def page_after(spark: SparkSession, path: str, cursor: tuple, size: int, newest: str = "detected_at", key: str = "id") -> DataFrame:
    """The rows that follow the one with ``cursor`` = (newest, key) in the list; a list that has grown meanwhile shifts nothing."""
    at, last = F.lit(cursor[0]), F.lit(cursor[1])
    rows = spark.read.parquet(f"{path}/rows").drop(_RANGE, _PLACE)
    # A missing time comes last, after every other.
    behind = (F.col(newest) < at) | ((F.col(newest) == at) & (F.col(key) < last)) | F.col(newest).isNull() if cursor[0] is not None else F.col(newest).isNull() & (F.col(key) < last)
    return rows.where(behind).orderBy(*_order(newest, key)).limit(size)
