"""Helpers shared by the operators: table access, written intermediates, batched text in NumPy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts state it: `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"
#: Bytes of text that one NumPy step works on at most, unless a single text is longer.
STEP_BYTES = 1 << 20

_OWN_FOLDER: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of this machine only where it is unset and the master is local."""
    global _OWN_FOLDER
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_FOLDER is None:
        _OWN_FOLDER = tempfile.mkdtemp(prefix="wardenframe-llm-")
    return f"file://{_OWN_FOLDER}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table: lineage ends there, and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo `divisor` (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into runs of about `most` bytes: (first row, row after the last, bytes, offsets from 0). Null is empty."""
    flat = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets_buffer, data_buffer = flat.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[flat.offset: flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    first, rows = 0, len(flat)
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def sum_per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring offsets; empty runs give 0."""
    totals = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return totals[offsets[1:]] - totals[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (shift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(members: str | bytes) -> np.ndarray:
    """True for the given bytes."""
    found = np.zeros(256, bool)
    found[list(members.encode() if isinstance(members, str) else members)] = True
    return found


def pack32(values: np.ndarray) -> bytes:
    """Numbers below 2**32 by significance of their bytes, so that small ones pack well in a shuffle."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack32(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
