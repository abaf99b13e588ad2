"""Records of JSON documents that fill whole files, read by as many tasks as their bytes ask for.

A file is read as text that is cut behind every closing brace, by Spark's own splits; no split knows where in the document
it begins. So the first pass gives, for every split, what it does to nesting and quotes, if it begins inside a string
and if it doesn't. Running sums over a file's splits then tell how each really begins. A second pass finds the lists
under the keys of the document, and a third cuts records; of a record that goes over a border the parts are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardenframe.session import materialise
from wardenframe.sources.scans import WRAPPER_KEYS

#: Text that is gone through at once, if no single piece is longer.
CHUNK_BYTES = 1 << 20
_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _LIST, _END = (ord(c) for c in '"\\{}[]')


def outside_strings(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """(whether each byte stands outside strings, whether the next one is inside), if the first one is ``inside`` or not."""
    quote, back = data == _QUOTE, data == _BACKSLASH
    if back.any():
        # A quote after an odd number of backslashes is part of a string.
        other = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))
        at = np.flatnonzero(quote)
        at = at[at > 0]
        quote[at[(at - 1 - other[at - 1]) % 2 == 1]] = False
    odd = (np.cumsum(quote) + inside) % 2 == 1
    return ~odd, bool(odd[-1]) if len(odd) else inside


def nesting(data: np.ndarray, outside: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the brackets outside strings, depth before each, depth after each)."""
    step = np.zeros(len(data), np.int8)
    step[(data == _OPEN) | (data == _LIST)] = 1
    step[(data == _CLOSE) | (data == _END)] = -1
    step[~outside] = 0
    at = np.flatnonzero(step)
    after = depth + np.cumsum(step[at], dtype=np.int64)
    return at, after - step[at], after


def _chunks(batches: Iterator[pa.RecordBatch], carried: tuple[str, ...]) -> Iterator[tuple[tuple, bool, bytes]]:
    """((file, block, ...) of a split, whether it is the first chunk of the split, bytes) in the order of the text. Every piece gets back the brace it ended with."""
    now = None
    for batch in batches:
        names = list(zip(*(batch.column(c).to_pylist() for c in ("file", "block", *carried))))
        texts = batch.column("value").cast(pa.binary())
        lengths = pc.binary_length(texts).to_pylist()
        first, held = 0, 0
        for k in range(1, len(names) + 1):
            held += lengths[k - 1]
            if k == len(names) or names[k][:2] != names[first][:2] or held + lengths[k] > CHUNK_BYTES:
                yield names[first], names[first][:2] != now, b"}".join(texts.slice(first, k - first).to_pylist()) + b"}"
                now, first, held = names[first][:2], k, 0


_PACKED = "file string, block long, at long, value binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a split that come in one batch as one row, so that what is joined and sorted is few rows, with their file named once."""
    for batch in batches:
        names = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        at, texts = batch.column("at").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist()
        begin = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
        rows = [(*names[low], at[low], b"}".join(texts[low:high])) for low, high in zip(begin, [*begin[1:], len(names)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=[c.split()[0] for c in _PACKED.split(", ")])


_EFFECT = "file string, block long, flips int, plain long, quoted long"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: whether it flips between inside and outside of strings, and its change of depth in both cases."""
    found: dict[tuple, list[int]] = {}
    for (file, block), _, text in _chunks(batches, ()):
        data = np.frombuffer(text, np.uint8)
        effect = found.setdefault((file, block), [0, 0, 0])
        for case in (0, 1):
            # A chunk begins as the chunks before it in the split leave off.
            outside, _ = outside_strings(data, bool(effect[0] ^ case))
            at, before, after = nesting(data, outside, 0)
            effect[1 + case] += int(after[-1]) if len(at) else 0
        effect[0] ^= int(outside_strings(data, False)[1])
    rows = [(*split, *effect) for split, effect in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in _EFFECT.split(", ")])


def _key_before(text: bytes, at: int) -> str | None:
    """The key whose value begins at ``at``."""
    head = text[max(0, at - 512): at].rstrip()  # a longer key is none of those that are looked for
    if not head.endswith(b":"):
        return None
    head = head[:-1].rstrip()
    begin = head.rfind(b'"', 0, len(head) - 1)
    return head[begin + 1: -1].decode("utf-8", "replace") if head.endswith(b'"') and begin >= 0 else None


_LISTS = "file string, block long, place long, key string"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of the document's own keys, by place: the key of a list of objects, and an empty one for any other list or object."""
    rows: list[tuple] = []
    inside, depth, place = False, 0, 0
    for (file, block, inside0, depth0), fresh, text in _chunks(batches, ("inside", "depth")):
        if fresh:
            inside, depth, place = inside0, depth0, 0
        data = np.frombuffer(text, np.uint8)
        outside, inside = outside_strings(data, inside)
        at, before, after = nesting(data, outside, depth)
        for k in np.flatnonzero((before == 1) & (after == 2)).tolist():
            spot = int(at[k])
            objects = data[spot] == _LIST and text[spot + 1:].lstrip()[:1] == b"{"
            rows.append((file, block, place + spot, (_key_before(text, spot) if objects else None) or ""))
        depth, place = int(after[-1]) if len(at) else depth, place + len(text)
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[c.split()[0] for c in _LISTS.split(", ")])


_PARTS = "file string, block long, place long, part string, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie in one split, and of others their tail of a split, what fills a split, and the head of one."""
    inside, depth, place, active = False, 0, 0, False
    open_: list[bytes] | None = None  # what there is of the record that is not complete
    kind, split = "tail", None
    rows: list[tuple] = []

    def emit(part: str, pieces: list[bytes], spot: int) -> None:
        rows.append((split[0], split[1], spot, part, b"".join(pieces).decode("utf-8", "replace")))

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[c.split()[0] for c in _PARTS.split(", ")])
        rows.clear()
        return out

    for name, fresh, text in _chunks(batches, ("inside", "depth", "level", "wrapper", "held")):
        if fresh:
            if open_ is not None:
                emit(kind, open_, place)
            split, (inside, depth, level, wrapper, held), place = name[:2], name[2:], 0
            active = level < 2 or (depth >= 2 and held == wrapper)
            open_, kind = ([], "middle") if active and depth > level else (None, "tail")
        data = np.frombuffer(text, np.uint8)
        outside, inside = outside_strings(data, inside)
        at, before, after = nesting(data, outside, depth)
        alive = np.full(len(at), active)
        if level == 2:
            # Lists of the document begin and end at its own level; the one under the wrapper key holds the records.
            own = np.flatnonzero(((before == 1) & (after == 2)) | ((before == 2) & (after == 1)))
            for k in own.tolist():
                active = bool(data[at[k]] == _LIST and _key_before(text, int(at[k])) == wrapper) if after[k] == 2 else False
                alive[k:] = active
        starts = at[(data[at] == _OPEN) & (before == level) & alive]
        ends = at[(data[at] == _CLOSE) & (after == level) & alive]
        done = 0
        if open_ is not None:
            if len(ends):
                open_.append(text[: ends[0] + 1])
                emit("head" if kind == "middle" else "whole", open_, place)
                open_, kind, done = None, "tail", 1
            else:
                open_.append(text)
        for low, high in zip(starts.tolist(), ends[done:].tolist()):
            emit("whole", [text[low: high + 1]], place + low + 1)
        if open_ is None and len(starts) > len(ends) - done:
            open_, kind = [text[starts[-1]:]], "tail"
        depth, place = int(after[-1]) if len(at) else depth, place + len(text)
        if rows:
            yield batch()
    if open_ is not None:
        emit(kind, open_, place)
        yield batch()


def read_json_arrays(spark: SparkSession, path: str, pattern: str = "*", keys: tuple[str, ...] = WRAPPER_KEYS, files: DataFrame | None = None) -> DataFrame:
    """``(file, record)``: the text of each object in the list that a file holds.

    A file is one document: a list of objects, or an object with a list of objects under one of ``keys`` (the first of them
    that holds one wins). An object without such a list is a record itself. ``files``, a table with a column ``file``,
    leaves out all others.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "}")
    read = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    pieces = read.mapInArrow(_packed, _PACKED)
    if files is not None:
        pieces = pieces.join(files.select("file"), "file", "left_semi").sortWithinPartitions("file", "block", "at")
    first = pieces.where("block = 0").groupBy("file").agg(F.min_by("value", "at").cast("string").alias("text"))
    kinds = first.select("file", F.col("text").rlike(r"^[\s\x{FEFF}]*\[").alias("plain"))
    ordered = Window.partitionBy("file").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # One row per split from here on: how it begins follows from the splits before it.
    effects = materialise((read if files is None else pieces).mapInArrow(_effects, _EFFECT), "json-splits").groupBy("file", "block").agg(F.sum("flips").alias("flips"), F.sum("plain").alias("plain_depth"), F.sum("quoted").alias("quoted_depth"))
    begun = effects.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    begun = begun.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("quoted_depth")).otherwise(F.col("plain_depth"))).over(before), F.lit(0)))
    begun = materialise(begun.select("file", "block", "inside", "depth").join(kinds, "file"), "json-begins")

    def with_begin(more: DataFrame) -> DataFrame:
        return pieces.join(more, ["file", "block"]).sortWithinPartitions("file", "block", "at")

    lists = materialise(with_begin(begun.where("NOT plain")).mapInArrow(_lists, _LISTS), "json-lists")
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    wrappers = lists.where(F.col("key").isin(*keys)).groupBy("file").agg(F.min_by("key", rank).alias("wrapper"))
    last = lists.groupBy("file", "block").agg(F.max_by("key", "place").alias("last"))
    held = F.last("last", ignorenulls=True).over(before)
    begun = begun.join(wrappers, "file", "left").join(last, ["file", "block"], "left").withColumn("held", held)
    begun = materialise(begun.withColumn("level", F.when(F.col("plain"), 1).when(F.col("wrapper").isNotNull(), 2).otherwise(0)).drop("last", "plain"), "json-begins")
    parts = materialise(with_begin(begun).mapInArrow(_cut, _PARTS), "json-parts")
    # Parts of records that go over borders, at most two per split: each tail begins a record.
    loose = parts.where("part <> 'whole'")
    in_file = Window.partitionBy("file").orderBy("block", "place")
    loose = loose.withColumn("number", F.sum((F.col("part") == "tail").cast("int")).over(in_file))
    joined = loose.groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda p: p["text"]), "").alias("record"))
    return parts.where("part = 'whole'").select("file", F.col("text").alias("record")).unionByName(joined.select("file", "record"))
