"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are cut into pre-tokens with positions, a block of neighbouring rows at a time. A block sends each
of its distinct pre-tokens once to the partition that the word hashes to; there every word of the corpus
is encoded once, and its ids go back to the blocks that asked. A block's positions are kept as codes into
its list of distinct words, and meet the ids again by block, where the texts are put together in order.
A word of any frequency thus travels once per block, not once per occurrence.

Both sides cut the same blocks, as both read the same rows in the same partitions; a checksum of each
block's words is compared when they meet, and a difference raises.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import pack32, shuffle_partitions, table, unpack32

#: Characters of text in a block (one longer text is a block of its own).
BLOCK_CHARS = 8_000_000
#: Texts longer than this are walked match by match, so that no list of all their words is made.
LONG_TEXT = 4_000_000
#: Rows that decoding hands on at once.
DECODED_ROWS = 500


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, pa.Array, np.ndarray, array, dict[str, int]]]:
    """(block, keys, word counts, codes, word to code) for runs of rows; codes count words by first occurrence."""
    import regex

    find = regex.compile(pattern)
    block, keys, counts, codes, index, chars = TaskContext.get().partitionId() << 32, [], [], array("I"), {}, 0
    for batch in batches:
        start = 0
        for row, text in enumerate(batch.column("text")):
            text = text.as_py() or ""
            if chars and chars + len(text) > BLOCK_CHARS:
                keys.append(batch.column("key").slice(start, row - start))
                yield block, pa.concat_arrays(keys), np.array(counts, np.int64), codes, index
                block, keys, counts, codes, index, chars, start = block + 1, [], [], array("I"), {}, 0, row
            before = len(codes)
            words = find.findall(text) if len(text) < LONG_TEXT else (m.group() for m in find.finditer(text))
            codes.extend([index.setdefault(w, len(index)) for w in words] if isinstance(words, list) else (index.setdefault(w, len(index)) for w in words))
            counts.append(len(codes) - before)
            chars += len(text)
        keys.append(batch.column("key").slice(start))
    if counts:
        yield block, pa.concat_arrays(keys), np.array(counts, np.int64), codes, index


def _by_bucket(index: dict[str, int], buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """Words in order of (bucket, code), their codes and buckets, and a checksum of the list."""
    words = [w.encode() for w in index]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    words = [words[k] for k in order]
    return words, order, bucket[order], zlib.crc32(b"\0".join(words))


def _dictionary(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, _, index in _blocks(batches, pattern):
            words, _, bucket, check = _by_bucket(index, buckets)
            found, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:], len(words)]
            bodies = [b"".join(words[a:b]) for a, b in zip(starts, ends)]
            sizes = [pack32(np.array([len(w) for w in words[a:b]])) for a, b in zip(starts, ends)]
            count = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * count, pa.int64()), pa.array(found.astype(np.int32)), pa.array([check] * count, pa.int64()), pa.array(sizes, pa.binary()), pa.array(bodies, pa.binary())],
                names=["block", "bucket", "checksum", "sizes", "body"],
            )
    return run


def _positions(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, counts, codes, index in _blocks(batches, pattern):
            _, order, _, check = _by_bucket(index, buckets)
            codes = np.frombuffer(codes, np.uint32) if len(codes) else np.zeros(0, np.uint32)
            # Frequent words first, so that most codes are small and pack well.
            rank = np.empty(len(index), np.uint32)
            rank[np.argsort(-np.bincount(codes, minlength=len(index)), kind="stable")] = np.arange(len(index), dtype=np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([check], pa.int64()), pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([counts.tolist()], pa.list_(pa.int64())),
                 pa.array([zlib.compress(pack32(rank[codes]), 1)], pa.binary()), pa.array([rank[order].tobytes()], pa.binary())],
                names=["block", "checksum", "keys", "counts", "codes", "order"],
            )
    return run


def _encode(shared_ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared_ranks.value, special_tokens={}).encode_ordinary
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            counts, ids = [], []
            for sizes, body in zip(batch.column("sizes"), batch.column("body")):
                body, found, at = body.as_py(), [], 0
                for size in unpack32(sizes.as_py()).tolist():
                    word = body[at: at + size]
                    at += size
                    if word not in known:
                        known[word] = tuple(encode(word.decode()))
                    found.append(known[word])
                counts.append(pack32(np.array([len(x) for x in found])))
                ids.append(pack32(np.array([i for x in found for i in x], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), batch.column("checksum"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["block", "bucket", "checksum", "counts", "ids"])
    return run


def _spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs `values[start: start + size]` one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _assemble(key_type: pa.DataType):
    def run(_key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        if len(blocks) != 1 or any(c != blocks["checksum"][0].as_py() for c in pc.unique(answers["checksum"]).to_pylist()):
            raise RuntimeError("the source gave other rows when it was read again; write it to a table first")
        none = np.zeros(0, np.int64)
        sizes = np.concatenate([none, *map(unpack32, answers["counts"].to_pylist())])
        ids = np.concatenate([none, *map(unpack32, answers["ids"].to_pylist())]).astype("<u4")
        rank = np.frombuffer(blocks["order"][0].as_py(), np.uint32)
        if len(rank) != len(sizes):
            raise RuntimeError("the source gave other rows when it was read again; write it to a table first")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        codes = unpack32(zlib.decompress(blocks["codes"][0].as_py()))
        starts = np.cumsum(sizes) - sizes
        words_per_row = np.array(blocks["counts"][0].as_py(), np.int64)
        keys, out_counts, out_ids, word = blocks["keys"].combine_chunks().values, [], [], 0
        for count in words_per_row.tolist():
            at = place[codes[word: word + count]]
            word += count
            tokens = _spread(ids, starts[at], sizes[at])
            out_counts.append(len(tokens))
            out_ids.append(tokens.tobytes())
        return pa.table({"key": keys.cast(key_type), "n_tokens": pa.array(out_counts, pa.int64()), "ids": pa.array(out_ids, pa.binary())})
    return run


def encode_texts(df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `n_tokens` and `ids` (little-endian unsigned 32-bit) of every row.

    Null and empty texts give no tokens. Repeated rows and keys, and null keys, give a row each; an empty
    table gives none. Other columns are not read. `ranks` is the vocabulary, a table of fixed size.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, buckets = rows.schema["key"].dataType, shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(ranks)
    words = rows.mapInArrow(_dictionary(pattern, buckets), "block long, bucket int, checksum long, sizes binary, body binary")
    answers = words.repartition(buckets, "bucket").mapInArrow(_encode(shared, pattern), "block long, bucket int, checksum long, counts binary, ids binary")
    name = kind.simpleString()
    blocks = rows.mapInArrow(_positions(pattern, buckets), f"block long, checksum long, keys array<{name}>, counts array<long>, codes binary, order binary")
    from pyspark.sql.pandas.types import to_arrow_type

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble(to_arrow_type(kind)), f"key {name}, n_tokens long, ids binary")
    return out.withColumnRenamed("key", key)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the bytes of each row's `ids`; a null or empty list gives no bytes, an id outside the table raises.

    The token-byte table has the vocabulary's fixed size, so each task gets all of it.
    """
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = df.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        lengths = np.array([len(t) for t in tokens], np.int64)
        starts, body = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), np.uint8)
        for batch in (b.slice(k, DECODED_ROWS) for b in batches for k in range(0, b.num_rows, DECODED_ROWS)):
            out = []
            for value in batch.column(ids):
                each = np.frombuffer(value.as_py() or b"", "<u4")
                out.append(_spread(body, starts[each], lengths[each]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, decoded])

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, `{decoded}` binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode_ids(coded, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
