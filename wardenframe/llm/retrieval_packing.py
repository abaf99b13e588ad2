"""Packing of related documents: a sharded BM25 index gives each seed its unused neighbours, which fill its window.

1. Every text is tokenized once. Windows that a long document fills alone are ready; only its tail goes on, with its ids.
2. Document frequencies of the tokens, over all tails, are summed by token: as many rows as the vocabulary.
3. Tails are range-partitioned by their two heaviest tokens, so that related ones come together; order goes on by
   content and row, so a heavy token of any number of tails is split.
4. A task walks its range in shards of bounded size. A shard is an inverted index: postings by token with BM25 weights,
   whose statistics are those of all tails. The next unused tail is the seed of a window; its neighbours come by
   falling score. One that is too long is cut, and its rest is the next seed. A window that a shard can't fill stays open
   for the next shard; the last of a task is cut into powers of two, so no padding is left.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import mix64, pack32, saved, table, unpack32

#: Tokens of a window, id that ends a document, BM25's saturation and length weight.
WINDOW, END_ID, K1, B = 1024, 0, 1.2, 0.75
#: Tails of a shard, tokens of a range, characters that are tokenized together.
SHARD_TAILS, RANGE_TOKENS, STEP_CHARS = 2048, 1 << 21, 1 << 20
#: Words after which a worker starts to learn afresh, and bits of their slots.
MOST_KNOWN, SLOT_BITS = 1 << 20, 22

_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
_ODD = 0x9E3779B97F4A7C15 | 1


def _kinds() -> np.ndarray:
    """Kind of every code point for which it is fixed beyond doubt; texts with others are left to the library as a whole."""
    kind = np.full(0x110000, _UNKNOWN, np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20B0)]:
        kind[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    kind[[*range(9, 14), 32, 0x85, 0xA0]] = _SPACE
    return kind


def word_starts(codes: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether each character begins a pre-token of the byte-level pattern; `firsts` are the first characters of texts."""
    count = len(codes)
    begins = np.ones(count + 1, bool)  # one more, so that the end of the last text begins something
    begins[1:count] = kinds[1:] != kinds[:-1]
    begins[firsts] = True
    text_start = np.zeros(count + 1, bool)
    text_start[firsts] = True
    text_start[count] = True
    run_start = begins.copy()
    # A space before a word belongs to it; white space before that, or another single white character, stands alone.
    after = np.flatnonzero(begins[1:count] & (kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~text_start[1:count]) + 1
    begins[after - 1] = True
    begins[after[codes[after - 1] == 32]] = False
    # Contractions: an apostrophe that begins a run by itself takes one or two letters.
    at = np.flatnonzero(run_start[:count] & begins[:count] & (codes == 39))
    at = at[~text_start[at + 1]]
    one = np.isin(codes[at + 1], [ord(c) for c in "stmd"])
    room = ~text_start[np.minimum(at + 2, count)]
    pair = codes[np.minimum(at + 1, count - 1)].astype(np.int64) * 256 + codes[np.minimum(at + 2, count - 1)]
    two = ~one & room & np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
    at, size = at[one | two], np.where(one, 1, 2)[one | two]
    begins[at + 1] = False
    begins[at + 1 + size] = True
    return begins[:count]


class Encoder:
    """Ids of whole texts by a tokenizer; every distinct pre-token is encoded once as long as it is known."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = _kinds()
        # Tokens that begin with the byte of a space.
        spaced = [t.startswith("\u0120") for t, _ in sorted(self.library.get_vocab().items(), key=lambda entry: entry[1])]
        self.spaced = np.array(spaced, bool)
        self.up = self.down = np.ones(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        # The slot of a word's hash holds its place plus one; a later word with the same slot takes it.
        self.known, self.used, self.slot = 0, 0, np.zeros(1 << SLOT_BITS, np.int32)
        self.name, self.first, self.size, self.pool = np.zeros(1024, np.uint64), np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32)

    def _learn(self, names: np.ndarray, words: list[str]) -> np.ndarray:
        """Encode new words, whose hashes are `names`, and give their places.

        Words of a space and letters are encoded in strings of many: these come apart at the spaces again.
        """
        plain = [k for k, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        other = [k for k, w in enumerate(words) if not (w[0] == " " and w[1:].isalpha())]
        joined = ["".join([words[k] for k in plain[low: low + 1000]]) for low in range(0, len(plain), 1000)]
        found = [e.ids for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        sizes = np.diff(np.append(np.flatnonzero(self.spaced[flat]), len(flat)))
        found = [e.ids for e in self.library.encode_batch_fast([words[k] for k in other], add_special_tokens=False)]
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, found), np.int64, len(found))])
        order = np.array(plain + other, np.int64)
        for label, need in (("name", self.known + len(words)), ("first", self.known + len(words)), ("size", self.known + len(words)), ("pool", self.used + len(flat))):
            if need > len(now := getattr(self, label)):
                setattr(self, label, np.concatenate([now, np.zeros(max(need - len(now), len(now)), now.dtype)]))
        new = slice(self.known, self.known + len(words))
        self.name[new], self.size[new] = names[order], sizes
        self.first[new] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used: self.used + len(flat)] = flat
        places = np.empty(len(words), np.int64)
        places[order] = self.known + np.arange(len(words))
        self.known += len(words)
        self.used += len(flat)
        return places

    def _plain(self, texts: list[str], codes: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
        if self.known > MOST_KNOWN:
            self._forget()
        if len(self.up) < len(codes) + 1:
            def powers(factor: int) -> np.ndarray:
                steps = np.full(len(codes) + 1, factor, np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)
            self.up, self.down = powers(_ODD), powers(pow(_ODD, -1, 1 << 64))
        starts = np.flatnonzero(word_starts(codes, kinds, firsts))
        ends = np.append(starts[1:], len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], dtype=np.uint64)])
        names = mix64((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        slots = (names >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at = self.slot[slots].astype(np.int64) - 1
        missed = np.flatnonzero((at < 0) | (self.name[at] != names))
        if len(missed):
            new, where, back = np.unique(names[missed], return_index=True, return_inverse=True)
            spots, whole = missed[where], "".join(texts)
            places = self._learn(new, [whole[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist())])
            at[missed] = places[back]
            self.slot[slots[spots]] = places + 1
        sizes = self.size[at]
        upto = np.cumsum(sizes, dtype=np.int64)
        ids = self.pool[np.repeat(self.first[at] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)].astype(np.int64)
        cuts = np.append(0, upto)[np.searchsorted(starts, firsts[1:])] if len(firsts) > 1 else []
        return np.split(ids, cuts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        filled = [k for k, t in enumerate(texts) if t]
        if not filled:
            return out
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.kind[codes]
        sizes = np.array([len(texts[k]) for k in filled])
        firsts = np.cumsum(sizes) - sizes
        strange = np.maximum.reduceat(kinds, firsts) == _UNKNOWN
        if strange.any():
            odd = [filled[k] for k in np.flatnonzero(strange).tolist()]
            for k in odd:
                out[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.int64)
            held = np.repeat(~strange, sizes)
            codes, kinds, sizes = codes[held], kinds[held], sizes[~strange]
            filled = [filled[k] for k in np.flatnonzero(~strange).tolist()]
            firsts = np.cumsum(sizes) - sizes
        if filled:
            for k, ids in zip(filled, self._plain([texts[k] for k in filled], codes, kinds, firsts)):
                out[k] = ids
        return out


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """The encoder of a Python worker: what it knows serves its next tasks too."""
    return Encoder(definition)


def ids_crc32(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


_PIECES = "start long, length int, doc_tokens long, ids_crc32 long, sequence_id long, ids binary"


def _sequence(count: int, kind: int) -> int:
    """Number of a task's next sequence: windows of one document are even, packed ones odd."""
    return ((TaskContext.get().partitionId() << 36) + count) * 2 + kind


def _tokenized(definition, window: int, end_id: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = _encoder(definition.value), 0
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            first = 0
            while first < len(sizes):
                last, held = first, 0
                while last < len(sizes) and (last == first or held + sizes[last] <= STEP_CHARS):
                    held += sizes[last]
                    last += 1
                rows: list[tuple] = []
                for key, ids in zip(batch.column("key").slice(first, last - first).to_pylist(), encoder.encode([t or "" for t in texts.slice(first, last - first).to_pylist()])):
                    ids = np.append(ids, end_id)
                    for start in range(0, len(ids), window):
                        part = ids[start: start + window]
                        if len(part) == window:
                            rows.append((key, start, window, len(ids), ids_crc32(part), _sequence(made, 0), None))
                            made += 1
                        else:
                            rows.append((key, start, len(part), len(ids), None, None, pack32(part)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                    names=["key", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "ids"],
                )
                first = last
    return run


def _bags(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, token, count) of the distinct tokens of each piece, by piece and token."""
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    both, counts = np.unique((owner << 32) | np.concatenate(pieces), return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, counts


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(0, np.int64)
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            _, token, _ = _bags([unpack32(x) for x in batch.column("ids").slice(low, 4096).to_pylist()])
            seen = np.bincount(token, minlength=len(found))
            seen[: len(found)] += found
            found = seen
    token = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(found[token])], names=["token", "df"])


@dataclass
class Statistics:
    """What BM25 knows of all tails: weight by token, mean length."""

    idf: np.ndarray
    mean: float

    @classmethod
    def of(cls, token: np.ndarray, df: np.ndarray, tails: int, tokens: int) -> Statistics:
        idf = np.zeros(int(token.max(initial=0)) + 1)
        idf[token] = np.log1p((tails - df + 0.5) / (df + 0.5))
        return cls(idf, tokens / max(tails, 1))

    def weights(self, piece: np.ndarray, token: np.ndarray, count: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[token] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[piece] / self.mean))


def _signed(statistics):
    """Tails with their two heaviest tokens, by which related ones come together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.zeros((2, batch.num_rows), np.int64)
            for low in range(0, batch.num_rows, 4096):
                pieces = [unpack32(x) for x in batch.column("ids").slice(low, 4096).to_pylist()]
                piece, token, count = _bags(pieces)
                weight = statistics.value.weights(piece, token, count, np.array([len(p) for p in pieces]))
                first = np.searchsorted(piece, np.arange(len(pieces)))
                for rank in range(2):
                    top = np.maximum.reduceat(weight, first)
                    # The smallest token of equally heavy ones; a tail with one token has no second.
                    _, spot = np.unique(piece[at := np.flatnonzero(weight == top[piece])], return_index=True)
                    lead[rank, low: low + len(pieces)] = np.where(np.isneginf(top), -1, token[at[spot]])
                    weight[at[spot]] = -np.inf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead[0]), pa.array(lead[1])], names=[*batch.schema.names, "lead", "second"])
    return run


class Index:
    """Inverted index of a shard: postings by token, with their BM25 weights."""

    def __init__(self, pieces: list[np.ndarray], statistics: Statistics) -> None:
        self.count = len(pieces)
        piece, token, count = _bags(pieces)
        weight = statistics.weights(piece, token, count, np.array([len(p) for p in pieces]))
        order, plain = np.argsort(token, kind="stable"), token
        self.piece, self.weight, token = piece[order], weight[order], token[order]
        self.token, self.first = np.unique(token, return_index=True)
        self.size = np.diff(np.append(self.first, len(token)))
        # Tokens of each piece, as places in `token`.
        self.begin, self.own = np.searchsorted(piece, np.arange(self.count + 1)), np.searchsorted(self.token, plain)

    def keep(self, free: np.ndarray) -> None:
        """Drop the postings of pieces that are used."""
        held = free[self.piece]
        upto = np.concatenate([[0], np.cumsum(held)])
        self.first, self.size = upto[self.first], upto[self.first + self.size] - upto[self.first]
        self.piece, self.weight = self.piece[held], self.weight[held]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 score of every piece for the distinct tokens of `query`."""
        wanted = np.unique(query)
        at = np.minimum(np.searchsorted(self.token, wanted), len(self.token) - 1)
        return self._sums(at[self.token[at] == wanted])

    def scores_for(self, piece: int) -> np.ndarray:
        """The same for the tokens of a piece of the index."""
        return self._sums(self.own[self.begin[piece]: self.begin[piece + 1]])

    def _sums(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        upto = np.cumsum(size)
        spots = np.repeat(self.first[at] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)
        return np.bincount(self.piece[spots], self.weight[spots], self.count)


@dataclass
class _Tail:
    key: object
    start: int
    doc_tokens: int
    ids: np.ndarray
    #: Number of the shard that it is in, and its place there.
    shard: int = -1
    place: int = -1


@dataclass
class _Window:
    """A window that is being filled. A seed that is the rest of a cut tail asks with the tokens of the whole tail in its own shard."""

    seed: _Tail
    parts: list[_Tail] = field(default_factory=list)
    held: int = 0


class Packer:
    """Packs shards of tails one after the other; `rows` are (key, start, length, doc_tokens, crc32, sequence, offset)."""

    def __init__(self, statistics: Statistics, window: int) -> None:
        self.statistics, self.window = statistics, window
        self.open: _Window | None = None
        self.rest: _Tail | None = None
        self.rows: list[tuple] = []
        self.made = self.number = 0

    def _put(self, tail: _Tail) -> None:
        """The tail, or what of it there is room for, into the open window; what is left over is the next seed."""
        if self.open is None:
            self.open = _Window(tail)
        now = self.open
        size = min(len(tail.ids), self.window - now.held)
        now.parts.append(_Tail(tail.key, tail.start, tail.doc_tokens, tail.ids[:size]))
        now.held += size
        self.rest = _Tail(tail.key, tail.start + size, tail.doc_tokens, tail.ids[size:], tail.shard, tail.place) if size < len(tail.ids) else None
        if now.held == self.window:
            self._close(now.parts)
            self.open = None

    def _close(self, parts: list[_Tail]) -> None:
        offset, number = 0, _sequence(self.made, 1)
        for p in parts:
            self.rows.append((p.key, p.start, len(p.ids), p.doc_tokens, ids_crc32(p.ids), number, offset))
            offset += len(p.ids)
        self.made += 1

    def shard(self, tails: list[_Tail]) -> None:
        index = Index([t.ids for t in tails], self.statistics)
        self.number += 1
        for place, tail in enumerate(tails):
            tail.shard, tail.place = self.number, place
        free, at, left, held = np.ones(len(tails), bool), 0, len(tails), len(tails)
        while left:
            if 4 * left < 3 * held:
                index.keep(free)
                held = left
            if self.open is None:
                if self.rest is not None:
                    self._put(self.rest)
                else:
                    while not free[at]:
                        at += 1
                    free[at] = False
                    left -= 1
                    self._put(tails[at])
                continue
            seed = self.open.seed
            scores = np.where(free, index.scores_for(seed.place) if seed.shard == self.number else index.scores(seed.ids), -1.0)
            # A few neighbours fill a window; more are ordered only where they don't.
            few = min(64, len(tails))
            for best in (np.argpartition(-scores, few - 1)[:few], None):
                best = np.argsort(-scores, kind="stable") if best is None else best[np.lexsort((best, -scores[best]))]
                for k in best.tolist():
                    if self.open is None or not left:
                        break
                    if free[k]:
                        free[k] = False
                        left -= 1
                        self._put(tails[k])
                if self.open is None or not left:
                    break

    def finish(self) -> None:
        """Cut what is open into sequences of powers of two, which need no padding."""
        while self.rest is not None:
            self._put(self.rest)
        if self.open is None:
            return
        parts, held = self.open.parts, self.open.held
        for size in (1 << k for k in range(held.bit_length() - 1, -1, -1) if held >> k & 1):
            own: list[_Tail] = []
            while size:
                p = parts.pop(0)
                taken = min(size, len(p.ids))
                own.append(_Tail(p.key, p.start, p.doc_tokens, p.ids[:taken]))
                if taken < len(p.ids):
                    parts.insert(0, _Tail(p.key, p.start + taken, p.doc_tokens, p.ids[taken:]))
                size -= taken
            self._close(own)
        self.open = None


def _packed(statistics, window: int, kind: pa.DataType):
    names = ["key", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(statistics.value, window), []

        def written() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                columns = list(zip(*packer.rows))
                packer.rows = []
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)
        for batch in batches:
            for low in range(0, batch.num_rows, SHARD_TAILS):
                part = batch.slice(low, SHARD_TAILS)
                held += [_Tail(key, start, total, unpack32(ids)) for key, start, total, ids in zip(*(part.column(c).to_pylist() for c in ("key", "start", "doc_tokens", "ids")))]
                if len(held) >= SHARD_TAILS:
                    packer.shard(held[:SHARD_TAILS])
                    held = held[SHARD_TAILS:]
                    yield from written()
        if held:
            packer.shard(held)
        packer.finish()
        yield from written()
    return run


def pack_by_retrieval(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.

    A document is the ids of its whole text by the tokenizer file `tokenizer`, without special tokens, and then
    `end_id`; null and empty texts have that id alone. Each id lies in exactly one piece; the pieces of a sequence lie
    without gaps from 0. Sequences hold `window` ids, but for a few powers of two at the end of each range. Rows are
    packed one by one, whatever their keys; an empty table gives no rows; other columns are not read. Pre-tokens
    are told apart by 64 bits of hash; texts with letters of unusual scripts are encoded by the library as a whole.
    """
    if window < 1:
        raise ValueError("a window holds an id at least")
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as file:  # the driver's own file; its content goes to the tasks
        definition = spark.sparkContext.broadcast(file.read())
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    arrow = rows.limit(0).select("key").toArrow().schema.field("key").type
    pieces = saved(rows.mapInArrow(_tokenized(definition, window, end_id, arrow), f"key {kind}, {_PIECES}"), "token-pieces")
    out = ["key", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id"]
    alone = pieces.filter("ids IS NULL").select(*out, F.lit(0).cast("long").alias("offset"))
    tails = pieces.filter("ids IS NOT NULL").select("key", "start", "doc_tokens", "ids", "length")
    size = tails.agg(F.count("*").alias("tails"), F.sum("length").alias("tokens")).first()
    if not size["tails"]:
        return alone.withColumnRenamed("key", key)
    # At most one row per token of the vocabulary, whatever the documents.
    df_rows = tails.select("ids").mapInArrow(_frequencies, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).toArrow()
    statistics = spark.sparkContext.broadcast(Statistics.of(df_rows["token"].to_numpy(), df_rows["df"].to_numpy(), size["tails"], size["tokens"]))
    signed = tails.drop("length").mapInArrow(_signed(statistics), f"key {kind}, start long, doc_tokens long, ids binary, lead long, second long")
    order = ["lead", "second", F.crc32("ids"), F.xxhash64("key", "start"), F.monotonically_increasing_id()]
    # Written, because a range partitioning reads its input twice.
    ranges = saved(signed, "signed-tails").select("*", *(c.alias(f"_o{k}") for k, c in enumerate(order[2:]))).repartitionByRange(max(1, -(-size["tokens"] // RANGE_TOKENS)), "lead", "second", "_o0", "_o1", "_o2")
    packed = ranges.sortWithinPartitions("lead", "second", "_o0", "_o1", "_o2").select("key", "start", "doc_tokens", "ids")
    packed = packed.mapInArrow(_packed(statistics, window, arrow), f"key {kind}, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long, offset long")
    return alone.unionByName(packed).withColumnRenamed("key", key)


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_by_retrieval(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
