"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest length are cut into pieces of it. Pieces are dealt evenly into groups of
about `GROUP_PIECES`; each group is packed by itself, longest piece first: a piece goes where it leaves
the least room, and where it fits nowhere a bin of the length with the least cost per expected content is
opened. In the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import WHITE_CLASS, saved, table

#: Permitted lengths in tokens, tokens that each sequence costs besides its length, pieces per group.
LENGTHS = (256, 512, 1024, 2048, 4096)
OVERHEAD = 16
GROUP_PIECES = 8192


def opening_length(piece: int, rest: int, lengths: Sequence[int], overhead: int) -> int:
    """Permitted length with the least cost per token, if it is filled from what is left; the smaller of equals."""
    fitting = [c for c in lengths if c >= piece]
    return min(fitting, key=lambda c: ((c + overhead) / min(c, rest), c))


def best_fit(sizes: Sequence[int], lengths: Sequence[int], overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset, length of the bin) of every piece; pieces come longest first. Empty pieces fit anywhere."""
    lengths = sorted(lengths)
    rest = sum(sizes)
    open_: list[tuple[int, int]] = []  # (room, bin), sorted
    capacity: list[int] = []
    room: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        at = bisect_left(open_, (size, -1))
        if at < len(open_):
            left, chosen = open_.pop(at)
        else:
            left = opening_length(size, max(rest, 1), lengths, overhead)
            chosen = len(capacity)
            capacity.append(left)
            room.append(left)
        bins.append(chosen)
        offsets.append(capacity[chosen] - left)
        room[chosen] = left - size
        insort(open_, (left - size, chosen))
        rest -= size
    final = [next(c for c in lengths if c >= capacity[b] - room[b]) for b in range(len(capacity))]
    return bins, offsets, [final[b] for b in bins]


def pack_sequences(df: DataFrame, key: str, size: str, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: key, `piece` (from 0), `piece_start`, `piece_tokens`, `pack_group`, `bin_id`, `bin_offset`, `bin_length`.

    A bin is the pair (`pack_group`, `bin_id`); its pieces lie without gaps from 0. Null and negative sizes
    count as 0, and an empty text has one piece of 0 tokens. Repeated rows and keys are packed one by one;
    equal pieces go in order of key and start. An empty table gives no rows; other columns are not read.
    """
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    most = lengths[-1]
    rows = df.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    pieces = rows.select("key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(size - 1) div {most}"), F.lit(0).cast("long")))).alias("piece"))
    pieces = pieces.select("key", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("size") - F.col("piece") * most).cast("int").alias("tokens"))
    pieces = saved(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # The group depends on the whole row and a number within equal ones only through the hash: any key spreads evenly.
    deal = F.pmod(F.xxhash64("key", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    kind = rows.schema["key"].dataType.simpleString()

    def pack(_key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("tokens", "descending"), ("key", "ascending"), ("start", "ascending")])
        bins, offsets, final = best_fit(group["tokens"].to_pylist(), lengths, overhead)
        return group.append_column("bin_id", pa.array(bins, pa.int32())).append_column("bin_offset", pa.array(offsets, pa.int32())).append_column("bin_length", pa.array(final, pa.int32()))

    packed = pieces.withColumn("pack_group", deal).groupBy("pack_group").applyInArrow(pack, f"key {kind}, piece long, start long, tokens int, pack_group int, bin_id int, bin_offset int, bin_length int")
    return packed.select(F.col("key").alias(key), "piece", F.col("start").alias("piece_start"), F.col("tokens").alias("piece_tokens"), "pack_group", "bin_id", "bin_offset", "bin_length")


def text_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and `n_words`, the number of runs without ASCII white space; null texts have none."""
    return df.select(F.col(key), F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{WHITE_CLASS[1:]}+")), F.lit(0)).alias("n_words"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(text_words(table(spark, sf_dir, "documents")), "doc_id", "n_words")
