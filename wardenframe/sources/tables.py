"""The given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, read as it lies."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
