"""A store of records by key, cut into buckets, with a Bloom filter per bucket.

An append asks the filters first. Records whose key no filter can have seen are new without a look at the store; for the
others the store is read, but only the buckets that they are in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.operators.serving import first_per_key, new_records
from wardenframe.session import materialise

#: Buckets of a store, bits of a bucket's filter, bits that a key sets. A bucket of a hundred thousand keys lets about one in seventy others pass.
BUCKETS, FILTER_BITS, HASHES = 64, 1 << 20, 3
_BUCKET = "_bucket"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _bits(keys: Sequence[str]) -> Column:
    """The places that a key sets in the filter of its bucket."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(f"bit{i}"), *keys), F.lit(FILTER_BITS)) for i in range(HASHES)])


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing there yet
            raise
        return None


def read_filters(spark: SparkSession, path: str) -> DataFrame | None:
    """(bucket, segment, bitmap) of all appends together; None where there is no store."""
    kept = _read(spark, f"{path}/filters")
    return None if kept is None else kept.groupBy(_BUCKET, "segment").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))


def _filter_rows(records: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    bits = records.select(_bucket(keys, buckets).alias(_BUCKET), F.explode(_bits(keys)).alias("bit"))
    return bits.groupBy(_BUCKET, F.bitmap_bucket_number("bit").alias("segment")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def with_suspicion(records: DataFrame, keys: Sequence[str], filters: DataFrame, buckets: int) -> DataFrame:
    """``records`` with ``_known``: all bits of the key are set in the filter of its bucket, so the store may hold it."""
    # Only keys and bits go to the filters; a record has HASHES bits.
    asked = records.select(*keys).distinct().select(*keys, _bucket(keys, buckets).alias(_BUCKET), F.explode(_bits(keys)).alias("bit"))
    asked = asked.withColumns({"segment": F.bitmap_bucket_number("bit"), "_at": F.bitmap_bit_position("bit")})
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = asked.join(filters, [_BUCKET, "segment"], "left").withColumn("_set", F.coalesce((F.call_function("shiftright", byte, (F.col("_at") % 8).cast("int")) % 2) == 1, F.lit(False)))
    known = found.groupBy(*keys).agg(F.every("_set").alias("_known")).withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return records.join(known, same).select(*records.columns, "_known")


def append_by_bucket(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = BUCKETS) -> list[int]:
    """Append the records whose key the store does not hold yet, one per key, and return the buckets of the store that were read.

    Of equal keys the first by ``order``, then by all columns, is taken. Filters are written before records: if a job dies in
    between, keys are looked for in vain, but none is taken twice. Keys may be NULL; two missing ones are different.
    The number of buckets belongs to the store and stays.
    """
    spark = df.sparkSession
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    fresh = materialise(first_per_key(df, keys, rest) if rest else df.distinct(), "store-batch")
    filters, touched = read_filters(spark, path), []
    if filters is not None:
        marked = materialise(with_suspicion(fresh, keys, filters, buckets), "store-suspects")
        suspects = marked.where("_known").drop("_known")
        # One row per bucket at most.
        touched = sorted(r[_BUCKET] for r in suspects.select(_bucket(keys, buckets).alias(_BUCKET)).distinct().collect())
        held = _read(spark, f"{path}/records")
        new = suspects if held is None else new_records(suspects, held.where(F.col(_BUCKET).isin(touched)), keys)
        fresh = materialise(marked.where("NOT _known").drop("_known").unionByName(new), "store-new")
    _filter_rows(fresh, keys, buckets).write.mode("append").parquet(f"{path}/filters")
    fresh.withColumn(_BUCKET, _bucket(keys, buckets)).write.mode("append").partitionBy(_BUCKET).parquet(f"{path}/records")
    return touched


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records").drop(_BUCKET)
