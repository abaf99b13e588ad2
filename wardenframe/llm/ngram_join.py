"""Similarity self-join of documents on the Jaccard similarity of their n-gram sets.

Documents with equal sets form a class, and classes are joined. Grams are ordered by the number of classes
that hold them, rare ones first; two similar classes share a gram among the first few (the prefix) of both.

1. Every text gives its set of 64-bit gram hashes, of which only size and fingerprint leave the task; equal
   ones form the classes.
2. Grams travel in packed form to the partition that they hash to, once per class and task. Those of one
   class only cannot link anything and stop there; the others return to their class with their frequency.
   Grams that a large share of all texts hold are found beforehand and skip the partition by gram.
3. A class whose prefix holds grams of its own only has no partner. The others are tied by the grams of
   their prefixes into clusters; no pair is formed for it.
4. A cluster is cut into blocks, and pairs of blocks are worked on by tasks of bounded size: prefix join,
   length, positional and suffix filter, then one verification for each pair that is left. A task returns
   link counts and a spanning forest of its links, so results grow with the classes and not with the pairs.
5. Components of the forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import WHITE, byte_table, mix64, pack32, saved, shuffle_partitions, table, text_steps, unpack32
from wardenframe.llm.components import components, forest

#: Words of a gram, and the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Bytes of grams that a task gathers before it hands them on; members of a block; bins of the suffix filter.
FLUSH_BYTES, BLOCK, SUFFIX_BINS = 16 << 20, 256, 32
#: Grams of a tile's sets that are counted together.
SLICE_GRAMS = 1 << 22
#: A gram is hot from this share of a task's texts on (and this count), and then from this share of all texts on.
HOT_TASK_SHARE, HOT_LEAST, HOT_SHARE = 0.01, 64, 0.005
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as they were needed."""

    up: np.ndarray
    down: np.ndarray

    @classmethod
    def upto(cls, count: int) -> _Powers:
        def row(factor: int) -> np.ndarray:
            steps = np.full(count, factor, np.uint64)
            steps[:1] = 1
            return np.multiply.accumulate(steps)
        return cls(row(_ODD), row(_INVERSE))


def gram_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text in order the sorted hashes of its distinct grams.

    Words are runs without ASCII white space, with A-Z lowered. A text with fewer words than a gram has one
    gram of all its words; without words, or null, none.
    """
    white, lower = byte_table(WHITE), np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    powers = _Powers.upto(1 << 21)
    for _, _, data, offsets in text_steps(texts):
        if len(powers.up) < len(data) + 1:
            powers = _Powers.upto(len(data) + 1)
        gap = white[data]
        edge = np.ones(len(data), bool)
        edge[1:] = gap[:-1]
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(edge & ~gap)
        tail = np.ones(len(data), bool)
        tail[:-1] = gap[1:]
        tail[offsets[1:][offsets[1:] > 0] - 1] = True
        ends = np.flatnonzero(tail & ~gap) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower[data].astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], dtype=np.uint64)])
        word = mix64((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64) * _STEP)
        grams = word[: max(len(word) - words + 1, 0)].copy()
        for k in range(1, words):
            grams = grams * _STEP + word[k: k + len(grams)]
        grams = mix64(grams + np.uint64(words))
        bounds = np.searchsorted(starts, offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= words:
                yield np.unique(grams[a: b - words + 1])
            elif b > a:
                short = np.uint64(0)
                with np.errstate(over="ignore"):
                    for w in word[a:b]:
                        short = short * _STEP + w
                yield mix64(np.array([short + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """80 bits of a set, as signed numbers of 16 and 64 bits: short, as they go with every part of a set."""
    high = mix64(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    low = mix64(grams + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(high.view(np.int64) >> 48), int(low.view(np.int64))


class _Frequent:
    """Grams that a task meets often: counted by hash, then exactly from the time their bin is full enough."""

    def __init__(self) -> None:
        self.bins, self.exact, self.texts = np.zeros(1 << 20, np.uint32), {}, 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.texts += len(sets)
        grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = (grams >> np.uint64(44)).astype(np.int64)
        self.bins += np.bincount(at, minlength=len(self.bins)).astype(np.uint32)
        often = grams[self.bins[at] >= max(HOT_LEAST, HOT_TASK_SHARE * self.texts)]
        for gram, count in zip(*(x.tolist() for x in np.unique(often, return_counts=True))):
            if gram in self.exact or count >= 2:
                self.exact[gram] = self.exact.get(gram, 0) + count

    def found(self) -> list[tuple[int, int]]:
        least = max(HOT_LEAST, HOT_TASK_SHARE * self.texts) / 2
        return [(g, n) for g, n in self.exact.items() if n >= least]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sizes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = _Frequent(), set()
        for batch in batches:
            found, fresh, held = [], [], 0
            for grams in gram_sets(batch.column("text"), words):
                marks = fingerprint(grams)
                found.append((len(grams), *marks))
                if marks not in seen:
                    seen.add(marks)
                    fresh.append(grams)
                    held += grams.nbytes
                    if held > FLUSH_BYTES:
                        often.add(fresh)
                        fresh, held = [], 0
            often.add(fresh)
            n, high, low = zip(*found) if found else ((), (), ())
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), none, none], names=["id", "n", "hi", "lo", "gram", "count"])
        rows = often.found()
        if rows:
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), batch.column("id").type), none, none, none, _signed([g for g, _ in rows]), pa.array([c for _, c in rows], pa.int64())], names=["id", "n", "hi", "lo", "gram", "count"])
    return run


def _cut48(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _join48(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


#: Number of no bucket of grams: hot grams are named by it and their place in the hot list.
_HOT_BUCKET = 0xFFFF
_ID = np.dtype([("hi", "<i2"), ("lo", "<i8")])
_PACKED = "bucket int, source int, hot boolean, ids binary, counts binary, grams binary, freq binary"
_PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("source", pa.int32()), ("hot", pa.bool_()), *[(n, pa.binary()) for n in ("ids", "counts", "grams", "freq")]])


def _pack(bucket: int, source: int, hot: bool, owner: np.ndarray, marks: np.ndarray, grams: np.ndarray, freq: np.ndarray | None = None) -> tuple:
    """A row with the grams of some classes; `owner` is the class of each gram (equal ones together), `marks` hold (hi, lo)."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    ids = np.empty(len(first), _ID)
    ids["hi"], ids["lo"] = marks[owner[first]].T
    return bucket, source, hot, ids.tobytes(), pack32(np.diff(np.append(first, len(owner)))), _cut48(grams), b"" if freq is None else pack32(freq)


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED_SCHEMA.types)], schema=_PACKED_SCHEMA)


def _deal(words: int, buckets: int, shared_hot):
    """Grams of the classes that a task meets first, to buckets by gram; hot ones apart with their place in the hot list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = shared_hot.value, set()
        sets, marks, held, flushed = [], [], 0, 0

        def flush() -> list[tuple]:
            known = np.array(marks, np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            grams = np.concatenate(sets)
            rows = []
            if len(hot):
                place = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                is_hot = hot[place] == grams
                if is_hot.any():
                    rows.append(_pack((flushed * 7919 + int(known[0, 1])) % buckets, 0, True, owner[is_hot], known, place[is_hot].astype(np.uint64)))
                    owner, grams = owner[~is_hot], grams[~is_hot]
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, rest = bucket[order], owner[order], (grams // np.uint64(buckets))[order] & np.uint64((1 << 48) - 1)
            found, begin = np.unique(bucket, return_index=True)
            for b, low, high in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)]):
                rows.append(_pack(b, b, False, owner[low:high], known, rest[low:high]))
            return rows

        for batch in batches:
            for grams in gram_sets(batch.column("text"), words):
                if len(grams) and (mark := fingerprint(grams)) not in seen:
                    seen.add(mark)
                    sets.append(grams)
                    marks.append(mark)
                    held += grams.nbytes
                    if held > FLUSH_BYTES:
                        yield _packed_batch(flush())
                        sets, marks, held, flushed = [], [], 0, flushed + 1
        if sets:
            yield _packed_batch(flush())
    return run


def _column(rows: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows[name].to_pylist()), kind)


def _classes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct (hi, lo) of the packed rows in order, class of each gram, the grams, their packed row)."""
    ids = _column(rows, "ids", _ID)
    hi, lo = ids["hi"].astype(np.int64), ids["lo"].astype(np.int64)
    order = np.lexsort((lo, hi))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    kept = order[fresh]
    counts = [unpack32(c) for c in rows["counts"].to_pylist()]
    row = np.repeat(np.arange(len(counts)), [int(c.sum()) for c in counts])
    return np.stack([hi[kept], lo[kept]], axis=1).reshape(-1, 2), np.repeat(number, np.concatenate([*counts, np.zeros(0, np.int64)])), _join48(b"".join(rows["grams"].to_pylist())), row


def _by_class(source: int, hot: bool, owner: np.ndarray, known: np.ndarray, grams: np.ndarray, freq: np.ndarray, targets: int) -> list[tuple]:
    """Packed rows of grams with frequencies, to buckets by class."""
    target = (known[:, 1] % targets)[owner]
    order = np.lexsort((owner, target))
    owner, target, grams, freq = owner[order], target[order], grams[order], freq[order]
    found, begin = np.unique(target, return_index=True)
    return [
        _pack(q, source, hot, owner[low:high], known, grams[low:high], freq[low:high])
        for q, low, high in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(owner)])
    ]


def _count(targets: int):
    """Frequencies of one bucket's grams; those of one class alone are left out."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, out = key[0].as_py(), []
        plain, hot = rows.filter(pc.invert(rows["hot"])), rows.filter(rows["hot"])
        if len(plain):
            known, owner, grams, _ = _classes(plain)
            order = np.lexsort((owner, grams))
            owner, grams = owner[order], grams[order]
            new_gram = np.ones(len(grams), bool)
            new_gram[1:] = grams[1:] != grams[:-1]
            kept = new_gram.copy()
            kept[1:] |= owner[1:] != owner[:-1]
            owner, grams = owner[kept], grams[kept]
            run_id = np.cumsum(new_gram[kept]) - 1
            freq = np.bincount(run_id)[run_id] if len(run_id) else np.zeros(0, np.int64)
            shared = freq > 1
            out += _by_class(bucket, False, owner[shared], known, grams[shared], freq[shared], targets)
        if len(hot):
            known, owner, place, _ = _classes(hot)
            out += _by_class(_HOT_BUCKET, True, owner, known, place, np.zeros(len(place), np.int64), targets)
        return pa.Table.from_batches([_packed_batch(out)] if out else [], schema=_PACKED_SCHEMA)
    return run


_SETS = "hi long, lo long, n long, own long, grams binary, prefix array<long>"


def _prefixes(percent: int):
    """Classes of one bucket with their shared grams, rare ones first, if their prefix holds any."""
    def run(_key: tuple, rows: pa.Table, sizes: pa.Table) -> pa.Table:
        known, owner, grams, row = _classes(rows)
        source, hot = rows["source"].to_numpy().astype(np.uint64), rows["hot"].to_numpy(zero_copy_only=False)
        freq = np.concatenate([np.zeros(0, np.int64), *map(unpack32, rows["freq"].to_pylist())])
        # Hot grams come after all others, in the order of the hot list.
        freq = np.where(hot[row], (1 << 32) + grams.astype(np.int64), freq)
        grams = grams | (source[row] << np.uint64(48))
        order = np.lexsort((grams, freq, owner))
        owner, grams = owner[order], grams[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
        owner, grams = owner[fresh], grams[fresh]
        all_sizes = np.stack([sizes[c].to_numpy() for c in ("hi", "lo", "n")], axis=1)
        all_sizes = all_sizes[np.lexsort((all_sizes[:, 1], all_sizes[:, 0]))]
        ids = np.empty(len(all_sizes), _ID)
        ids["hi"], ids["lo"] = all_sizes[:, 0], all_sizes[:, 1]
        own_ids = np.empty(len(known), _ID)
        own_ids["hi"], own_ids["lo"] = known.T
        n = all_sizes[np.searchsorted(ids, own_ids), 2] if len(known) else np.zeros(0, np.int64)
        held = np.bincount(owner, minlength=len(known))
        starts = np.cumsum(held) - held
        own = n - held
        length = n - (percent * n + 99) // 100 + 1
        alive = np.flatnonzero(length > own)
        return pa.table({
            "hi": pa.array(known[alive, 0]), "lo": pa.array(known[alive, 1]), "n": pa.array(n[alive]), "own": pa.array(own[alive]),
            "grams": pa.array([grams[starts[k]: starts[k] + held[k]].tobytes() for k in alive.tolist()], pa.binary()),
            "prefix": pa.array([grams[starts[k]: starts[k] + min(length[k] - own[k], held[k])].view(np.int64) for k in alive.tolist()], pa.list_(pa.int64())),
        })
    return run


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(member, column) of every gram that two or more of the sets hold; columns in order of the gram."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    return member[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]


def _common(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices: a slice of the grams and a strip of columns at a time."""
    out = np.zeros((len(sets), len(sets)), np.float64)
    slices = -(-sum(map(len, sets)) // SLICE_GRAMS)
    for k in range(slices):
        part = sets if slices == 1 else [s[mix64(s) % np.uint64(slices) == np.uint64(k)] for s in sets]
        member, column = _incidence(part)
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [low, low + width])
            strip = np.zeros((len(sets), min(width, int(column[-1]) + 1 - low)), np.float32)
            strip[member[a:b], column[a:b] - low] = 1
            out += strip @ strip.T
    return np.rint(out).astype(np.int64)


@dataclass
class _Member:
    n: int
    own: int
    grams: np.ndarray
    prefix: int
    side: int
    copies: int


def linked_pairs(members: list[_Member], cross: bool, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as two index arrays) whose similarity reaches the limit; with `cross` only those of different sides."""
    count = len(members)
    n = np.array([m.n for m in members])
    left, right = np.triu_indices(count, 1)
    side = np.array([m.side for m in members])
    # Length filter: the smaller set must be large enough to hold the overlap.
    fine = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
    fine &= (side[left] != side[right]) | (not cross)
    left, right = left[fine], right[fine]
    # Overlap that the limit asks for: inter >= percent / (100 + percent) * (n + n).
    need = -(-percent * (n[left] + n[right]) // (100 + percent))
    # Prefix join with positional filter: the overlap can't exceed what follows the first common prefix gram.
    at, column = _incidence([m.grams[: m.prefix] for m in members])
    width = int(column.max()) + 1 if len(column) else 0
    if not width or not len(left):
        return left[:0], right[:0]
    place = np.full((count, width), -1, np.int32)
    order = np.concatenate([np.arange(m.prefix) + m.own for m in members])
    held = _positions_of(members, order)
    place[at, column] = held
    keep = np.zeros(len(left), bool)
    for low in range(0, len(left), chunk := max(1, (16 << 20) // (4 * width))):
        a, b = place[left[low: low + chunk]], place[right[low: low + chunk]]
        both = (a >= 0) & (b >= 0)
        # The first common gram in the global order has the least sum of places.
        total = np.where(both, a + b, np.iinfo(np.int32).max)
        first = total.argmin(axis=1)
        rows = np.arange(len(first))
        bound = 1 + np.minimum(n[left[low: low + chunk]] - a[rows, first] - 1, n[right[low: low + chunk]] - b[rows, first] - 1)
        keep[low: low + chunk] = both[rows, first] & (bound >= need[low: low + chunk])
    left, right, need = left[keep], right[keep], need[keep]
    # Suffix filter: sets cut into parts by hash overlap by the smaller of each two parts at most.
    parts = np.stack([np.bincount((mix64(m.grams) % np.uint64(SUFFIX_BINS)).astype(np.int64), minlength=SUFFIX_BINS) for m in members])
    keep = np.concatenate([np.minimum(parts[left[k: k + 65536]], parts[right[k: k + 65536]]).sum(axis=1) >= need[k: k + 65536] for k in range(0, len(left), 65536)]) if len(left) else np.zeros(0, bool)
    left, right = left[keep], right[keep]
    # Each pair that is left is verified once, singly or all in one matrix product.
    if len(left) > 4 * count:
        inter = _common([m.grams for m in members])[left, right]
    else:
        inter = np.array([len(np.intersect1d(members[a].grams, members[b].grams, assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    linked = 100 * inter >= percent * (n[left] + n[right] - inter)
    return left[linked], right[linked]


def _positions_of(members: list[_Member], order: np.ndarray) -> np.ndarray:
    """Places, in their sets, of the prefix grams that `_incidence` keeps."""
    grams = np.concatenate([m.grams[: m.prefix] for m in members])
    _, column, counts = np.unique(grams, return_inverse=True, return_counts=True)
    return order[(counts > 1)[column]].astype(np.int32)


_LINKS = "hi long, lo long, to_hi long, to_lo long, classes long, rows long"


def _tile_links(rows: pa.Table, percent: int) -> np.ndarray:
    """Link counts and a spanning forest of one tile, as rows of `_LINKS`."""
    members = [
        _Member(n, own, np.frombuffer(grams, np.uint64), prefix, side, copies)
        for n, own, grams, prefix, side, copies in zip(*(rows[c].to_pylist() for c in ("n", "own", "grams", "n_prefix", "block", "copies")))
    ]
    left, right = linked_pairs(members, rows["i"][0].as_py() != rows["j"][0].as_py(), percent)
    marks = np.stack([rows["hi"].to_numpy(), rows["lo"].to_numpy()], axis=1)
    copies = np.array([m.copies for m in members])
    both = np.concatenate([left, right])
    classes = np.bincount(both, minlength=len(members))
    texts = np.bincount(both, weights=copies[np.concatenate([right, left])], minlength=len(members)).astype(np.int64)
    top = forest(len(members), left, right)
    has = np.flatnonzero(classes)
    return np.column_stack([marks[has], marks[top[has]], classes[has], texts[has]])


def _tiles(percent: int):
    """Tiles come one after the other, in order of (root, i, j); one is held at a time."""
    def links(parts: list[pa.Table]) -> pa.RecordBatch:
        tile = pa.concat_tables(parts)
        found = _tile_links(tile, percent) if len(tile) > 1 else np.zeros((0, 6), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(6)], names=[x.split()[0] for x in _LINKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            root, i, j = (batch.column(c).to_numpy() for c in ("root", "i", "j"))
            cut = np.flatnonzero((root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1 if len(root) else np.zeros(0, int)
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(root)]):
                if low == high:
                    continue
                name = (root[low], i[low], j[low])
                if now not in (None, name):
                    yield links(held)
                    held = []
                now = name
                held.append(pa.Table.from_batches([batch.slice(low, high - low)]))
        if held:
            yield links(held)
    return run


def ngram_links(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Key, `n_shingles`, `component_id` (least key reachable by links, itself included), `n_links` of every row.

    Two rows link when `100 * intersection >= percent * union` of their sets of `words`-word grams; `n_links`
    counts the linked other rows. A text with fewer words has one gram of all of them; null, empty and blank
    texts have none and link with nothing (their component is their own key). Rows with equal sets all link.
    Repeated rows count one by one, and null keys are larger than all others. An empty table gives no rows;
    other columns are not read. Classes are told apart by 80 bits, and the grams of two sets by 48 bits of
    their hashes besides the bucket.
    """
    spark = df.sparkSession
    buckets = min(shuffle_partitions(spark), 60000)
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sizes = saved(docs.mapInArrow(_sizes(words), f"id {kind}, n long, hi long, lo long, gram long, count long"), "gram-sizes")
    rows = sizes.filter("n IS NOT NULL").select("id", "n", "hi", "lo")
    full = rows.filter("n > 0")
    total = full.count()
    # Each text holds at most its own grams, so fewer than (mean set size) / HOT_SHARE grams are this frequent.
    hot = sizes.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("count").alias("c")).filter(F.col("c") >= max(HOT_LEAST, HOT_SHARE * total)).select("gram").collect()
    shared_hot = spark.sparkContext.broadcast(np.sort(np.array([r["gram"] for r in hot], np.int64).view(np.uint64)))
    classes = saved(full.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n")), "gram-classes")

    dealt = docs.mapInArrow(_deal(words, buckets, shared_hot), _PACKED)
    counted = dealt.groupBy("bucket").applyInArrow(_count(buckets), _PACKED)
    homes = classes.select(F.pmod(F.col("lo"), F.lit(buckets)).cast("int").alias("bucket"), "hi", "lo", "n")
    sets = saved(counted.groupBy("bucket").cogroup(homes.groupBy("bucket")).applyInArrow(_prefixes(percent), _SETS), "gram-sets")

    # Clusters are named by `lo` alone: two classes with equal ones would only share a cluster.
    grams = sets.select("lo", F.explode("prefix").alias("gram"))
    least = grams.groupBy("gram").agg(F.min("lo").alias("least"), F.count("*").alias("n")).filter("n > 1").select("gram", "least")
    clusters = saved(components(grams.join(least, "gram").select("lo", "least").distinct(), "lo", "least"), "clusters")
    blocks = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(blocks, "root").select(F.col("node").alias("lo"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    members = sets.withColumn("n_prefix", F.size("prefix")).drop("prefix").join(placed, "lo").join(classes.select("hi", "lo", "copies"), ["hi", "lo"])
    tiles = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt_tiles = tiles.drop("blocks", "other").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = saved(dealt_tiles.mapInArrow(_tiles(percent), _LINKS), "gram-links")

    name = lambda hi, lo: F.concat_ws(":", F.col(hi), F.col(lo))
    roots = components(links.select(name("hi", "lo").alias("u"), name("to_hi", "to_lo").alias("v")))
    counts = links.groupBy("hi", "lo").agg(F.sum("rows").alias("rows"))
    linked = classes.withColumn("name", name("hi", "lo")).join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    linked = saved(linked, "linked")
    # Written, as are the classes below: joins of plain shuffles, in which a large group is free to be split.
    firsts = saved(linked.groupBy("root").agg(F.min("first").alias("component")), "firsts")
    per_class = linked.join(firsts, "root").join(counts, ["hi", "lo"], "left").select("hi", "lo", "component", (F.col("copies") - 1 + F.coalesce("rows", F.lit(0))).alias("n_links"))
    out = full.join(saved(per_class, "per-class"), ["hi", "lo"]).select("id", "n", "component", "n_links")
    out = out.union(rows.filter("n = 0").select("id", "n", "id", F.lit(0).cast("long")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n - count(*) AS whole, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
link AS (SELECT x, y FROM common WHERE 100 * shared >= 80 * whole),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id, coalesce(c.n, 0)::BIGINT AS n_links
FROM s LEFT JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) m ON m.x = s.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM link GROUP BY x) c ON c.x = s.doc_id
"""
