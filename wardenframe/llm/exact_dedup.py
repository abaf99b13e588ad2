"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

A text, without its white space, is the number `sum(byte * base**(bytes after it))` modulo two primes.
Long texts are cut into chunks that are hashed in parallel; two neighbouring hashes combine as
`left * base**length(right) + right`. Rows with equal fingerprints are compared with the row that stays,
chunk by chunk; a row that differs in any chunk leaves the group and is grouped again by its digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import WHITE, byte_table, saved, table, text_steps

#: Two primes below 2**31, so that products of two residues fit in 63 bits.
PRIMES = (2147483629, 2147483587)
BASE = 1000003
#: Characters of a chunk. `byte * residue` stays below 2**39, so 2**24 of them can be summed in 63 bits.
CHUNK = 1 << 18


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def chunks(text: Column) -> Column:
    """Array of at most `CHUNK` characters each; one empty chunk for an empty text."""
    count = F.greatest(F.ceil(F.length(text) / CHUNK).cast("int"), F.lit(1))
    return F.when(count == 1, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK))))


def _powers(count: int, prime: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo a prime, by doubling."""
    out = np.ones(1, np.int64)
    step = BASE % prime
    while len(out) < count:
        out = np.concatenate([out, out * step % prime])
        step = step * step % prime
    return out[:count]


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    white = byte_table(WHITE)
    powers: list[np.ndarray] = [np.ones(0, np.int64)] * 2
    for batch in batches:
        names, texts = batch.schema.names, batch.column("chunk")
        length = np.zeros(batch.num_rows, np.int64)
        found = [np.zeros(batch.num_rows, np.int64) for _ in PRIMES]
        shift = [np.zeros(batch.num_rows, np.int64) for _ in PRIMES]
        for first, last, data, offsets in text_steps(texts):
            kept = ~white[data]
            ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
            data = data[kept].astype(np.int64)
            sizes = np.diff(ends)
            length[first:last] = sizes
            if not len(powers[0]) > sizes.max(initial=0):
                powers = [_powers(int(sizes.max()) + 1, p) for p in PRIMES]
            after = np.repeat(ends[1:] - 1, sizes) - np.arange(len(data))
            for k, prime in enumerate(PRIMES):
                running = np.concatenate([[0], np.cumsum(data * powers[k][after])])
                found[k][first:last] = (running[ends[1:]] - running[ends[:-1]]) % prime
                shift[k][first:last] = powers[k][sizes]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names if n != "chunk"] + [pa.array(x) for x in (length, *found, *shift)],
            names=[n for n in names if n != "chunk"] + ["size", "f0", "f1", "s0", "s1"],
        )


def _appended(k: int) -> Callable[[Column, Column], Column]:
    """The hash so far, moved up by the length of the next chunk, plus that chunk's hash."""
    return lambda h, part: (h * part[f"s{k}"] + part[f"f{k}"]) % PRIMES[k]


def fingerprints(rows: DataFrame) -> DataFrame:
    """`rows` have `row` and `_text` besides what is carried; the text is replaced by `size`, `f0`, `f1`."""
    carried = [c for c in rows.columns if c != "_text"]
    cut = rows.select(*carried, F.posexplode(chunks(F.col("_text"))).alias("seq", "chunk"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in cut.drop("chunk").dtypes)
    hashed = cut.mapInArrow(_hash_chunks, f"{kinds}, size long, f0 long, f1 long, s0 long, s1 long")
    parts = F.array_sort(F.collect_list(F.struct("seq", "size", "f0", "f1", "s0", "s1")))
    joined = hashed.groupBy(*carried).agg(parts.alias("parts"))
    combine = [F.aggregate("parts", F.lit(0).cast("long"), _appended(k)).alias(f"f{k}") for k in range(2)]
    return joined.select(*carried, F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["size"]).alias("size"), *combine)


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: key, `keep_id`, `group_size`, `kept`, `text_sha256`, `n_chars`.

    Texts are equal when identical without ASCII white space; null counts as empty, and all empty texts
    form one group. The row with the most characters in the original text stays, then the smallest key
    (null last); of repeated rows exactly one stays. An empty table gives no rows; other columns are not read.
    """
    source = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    digest = F.sha2(normalised(F.col("_text")).cast("binary"), 256)
    rows = source.withColumns({"row": F.monotonically_increasing_id(), "n_chars": F.length("_text").cast("long"), "sha": digest})
    marks = saved(fingerprints(rows), "fingerprints")
    group = ["size", "f0", "f1"]
    # The row that stays is the smallest of (-characters, key is null, key, row); counts and minima combine before the shuffle.
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "row", "sha")).alias("best")
    # Written by themselves, both sides of the join are plain shuffles, and a large group's rows are free to be split.
    groups = saved(marks.groupBy(*group).agg(best, F.count("*").alias("group_size")), "groups")
    members = saved(marks.join(groups, group), "members")
    shared = members.filter("group_size > 1").select(F.col("id").alias("of"), F.col("sha").alias("digest"), F.col("best.row").alias("best_row"), (F.col("row") == F.col("best.row")).alias("stays"))
    shared = shared.groupBy("of", "digest", "best_row").agg(F.max("stays").alias("stays"))
    texts = source.select("id", digest.alias("sha"), normalised(F.col("_text")).alias("norm")).join(shared, F.col("id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("digest")))
    # Written, and the chunks that stay once more, as are the groups above: the join is one of two plain shuffles, in which
    # the copies of one text can be split. Only texts that are not alone get here.
    pieces = saved(texts.select("id", "sha", "best_row", "stays", F.posexplode(chunks(F.col("norm"))).alias("seq", "chunk")), "chunks")
    ours, theirs = pieces.drop("stays"), saved(pieces.filter("stays").groupBy("best_row", "seq").agg(F.first("chunk").alias("held")), "held-chunks")
    same = ours.join(theirs, ["best_row", "seq"], "left").select("id", "sha", "best_row", F.coalesce(F.col("chunk") == F.col("held"), F.lit(False)).alias("same"))
    odd = same.filter(~F.col("same")).select("id", "sha", "best_row").distinct()
    return _settle(marks, members, odd, group).select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), "n_chars")


def _settle(marks: DataFrame, members: DataFrame, odd: DataFrame, group: list[str]) -> DataFrame:
    """Rows with their group; those in `odd` (equal fingerprint, other text) are told apart by their digest."""
    odd = saved(odd, "unequal")
    if odd.isEmpty():
        return members.select("id", "sha", "n_chars", "group_size", F.col("best.id").alias("keep_id"), (F.col("row") == F.col("best.row")).alias("kept"))
    marks = marks.join(odd.select("sha").distinct().withColumn("apart", F.col("sha")), "sha", "left")
    group = [*group, "apart"]
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    marks = marks.withColumn("apart", F.coalesce("apart", F.lit("")))
    groups = saved(marks.groupBy(*group).agg(best, F.count("*").alias("group_size")), "groups")
    return marks.join(groups, group).select("id", "sha", "n_chars", "group_size", F.col("best.id").alias("keep_id"), (F.col("row") == F.col("best.row")).alias("kept"))


def drop_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df`, with all its columns, without the rows whose text another row keeps."""
    kept = saved(exact_groups(df, key, text), "exact-groups").filter("kept").select(F.col(key).alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n"))
    marked = df.withColumns({"_digest": F.sha2(normalised(F.col(text)).cast("binary"), 256), "_chars": F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")})
    out = marked.join(kept, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")) & (F.col("_chars") == F.col("_n")), "left_semi")
    if not df.groupBy(key).count().filter("count > 1").isEmpty():
        # Repeated keys: of rows that look like the kept one, one stays.
        out = out.dropDuplicates([key, "_digest"])
    return out.drop("_digest", "_chars")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256, n_chars FROM r
"""
