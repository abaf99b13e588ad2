"""Periodic runs of words, as maximal pairs found in an LCP-interval tree.

A run with smallest period q from word s over `length` words is the pair of positions (s, s + q): the words from
both on agree over `length - q` words and then differ, and the words before them differ. So runs of at least
`periods` periods are the maximal pairs (i, j) whose common prefix is at least (periods - 1) * (j - i) long, and
whose positions follow each other in their node of the tree: a position of the node between them would give a
smaller period. Nothing is extended.

A task works on many texts at once, and every text is whole:

1. Positions that can't lie in a run leave. Each word of a run but its last few starts a gram that comes again within
   a quarter of the run, so a stretch of neighbouring positions with a next occurrence bounds the periods in it,
   and larger gaps drop out, until nothing changes. What is left, and a period more on the right, is exact for runs.
2. Suffixes of the rest are sorted by prefix doubling, and the ranks of all steps give common prefixes (LCP).
3. The tree is walked bottom-up. A node keeps its positions in order, each with its class: the word to its left.
   Smaller children are merged into larger ones, and new neighbours of different classes are tested.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import table

#: Least words and least periods of a run; bytes of text that are worked on together, unless one text is longer.
LEAST_WORDS, LEAST_PERIODS, STEP_BYTES = 6, 4, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def word_numbers(texts: Sequence[list]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, texts one after the other; first word of each text and the end). Equal words of one text have equal numbers, words of two texts never."""
    sizes = [len(words) for words in texts]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    numbers, base = np.empty(int(starts[-1]), np.int64), 0
    for words, at in zip(texts, starts.tolist()):
        known = {w: k for k, w in enumerate(dict.fromkeys(words), base)}
        numbers[at: at + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        base += len(known)
    return numbers, starts


def least_common(least_words: int, periods: int) -> int:
    """Fewest words on which the two positions of a run agree."""
    return min(max(least_words - q, (periods - 1) * q) for q in range(1, least_words + 1))


def _next_gaps(numbers: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Distance from each position to the next one of its text with the same `width` words; 0 where there is none.

    Grams are compared by hash: equal grams always meet, and a false meeting only keeps positions that later steps refute.
    """
    count = len(numbers)
    gaps = np.zeros(count, np.int64)
    if count < width:
        return gaps
    gram = np.zeros(count - width + 1, np.uint64)
    for k in range(width):
        gram = gram * _ODD + numbers[k: k + len(gram)].astype(np.uint64)
    gram = (gram ^ (gram >> np.uint64(29))) * _ODD
    bits = np.uint64(int(count).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    # Sorted by gram and then position, in one word.
    order = np.sort((gram & ~mask) | np.arange(len(gram), dtype=np.uint64))
    at, kind = (order & mask).astype(np.int64), order >> bits
    same = np.flatnonzero(kind[1:] == kind[:-1])
    gaps[at[same]] = at[same + 1] - at[same]
    # Grams that cross into the next text hold words of two texts; what begins near an end has no gram.
    for k in range(1, width):
        ends = starts[1:] - k
        gaps[ends[(ends >= 0) & (ends < count)]] = 0
    return gaps


def _areas(numbers: np.ndarray, starts: np.ndarray, least_words: int, periods: int) -> np.ndarray:
    """Stretches of words (first, end) outside which no run has a word; they don't overlap and stay within their texts."""
    width = least_common(least_words, periods)
    gaps = _next_gaps(numbers, starts, width)
    at = np.flatnonzero(gaps)
    while True:
        owner = np.searchsorted(starts, at, side="right")
        apart = np.ones(len(at) + 1, bool)
        apart[1:-1] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        first, end = at[apart[:-1]], at[apart[1:]] + 1
        # A run that begins in such a stretch agrees with itself over (stretch + width - 1) words at most.
        most = np.maximum((end - first + width - 1) // (periods - 1), 1)
        small = gaps[at] <= np.repeat(most, end - first)
        if small.all():
            break
        at = at[small]
    text = np.searchsorted(starts, first, side="right") - 1
    end = np.minimum(end + width + most, starts[text + 1])
    # Overlapping stretches of one text become one.
    fresh = np.ones(len(first), bool)
    fresh[1:] = (first[1:] > np.maximum.accumulate(end)[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    return np.column_stack([first[begin], np.maximum.reduceat(end, begin)]) if len(begin) else np.zeros((0, 2), np.int64)


def _suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start positions in order of their suffixes, length of the common prefix of each with the one before it), by prefix doubling."""
    count = len(words)
    _, rank = np.unique(words, return_inverse=True)
    ranks, step = [rank.astype(np.int64)], 1
    while True:
        rank = ranks[-1]
        after = np.zeros(count, np.int64)
        after[: max(count - step, 0)] = rank[step:] + 1
        key = rank * (count + 1) + after
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        new = np.empty(count, np.int64)
        new[order] = fresh
        if fresh[-1] == count - 1:
            break
        ranks.append(new)
        step *= 2
    common = np.zeros(count, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        fits = np.flatnonzero((left < count) & (right < count))
        fits = fits[ranks[k][left[fits]] == ranks[k][right[fits]]]
        common[fits + 1] += 1 << k
        left[fits] += 1 << k
        right[fits] += 1 << k
    return order, common


def _maximal_pairs(order: list[int], common: list[int], least: int, periods: int, left_word: list[int]) -> list[Run]:
    """Runs (start, length, period) as the maximal pairs of neighbouring positions of the tree's nodes, walked bottom-up."""
    found: list[Run] = []
    times = periods - 1

    def test(i: int, j: int, depth: int) -> None:
        gap = j - i
        if gap * times <= depth and left_word[i] != left_word[j]:
            found.append((i, gap + depth, gap))

    def merged(one: list[int], other: list[int], depth: int) -> list[int]:
        """Positions of two children of a node; pairs of neighbours from different children are tested."""
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        if len(small) == 1:
            x = small[0]
            at = bisect_left(large, x)
            if at and (x - large[at - 1]) * times <= depth:
                test(large[at - 1], x, depth)
            if at < len(large) and (large[at] - x) * times <= depth:
                test(x, large[at], depth)
            large.insert(at, x)
            return large
        own = set(small)
        if 16 * len(small) < len(large):
            for x in small:
                large.insert(bisect_left(large, x), x)
            for x in small:
                at = bisect_left(large, x)
                if at and large[at - 1] not in own:
                    test(large[at - 1], x, depth)
                if at + 1 < len(large) and large[at + 1] not in own:
                    test(x, large[at + 1], depth)
            return large
        large.extend(small)
        large.sort()
        before = large[0]
        for x in large[1:]:
            if (x - before) * times <= depth and (x in own) != (before in own):
                test(before, x, depth)
            before = x
        return large

    open_: list[tuple[int, list[int]]] = []  # (depth, positions so far) of the nodes that are not complete, shallow ones first
    current = [order[0]]
    for position, depth in zip(order[1:], common[1:]):
        while open_ and open_[-1][0] > depth:
            deep, held = open_.pop()
            current = merged(held, current, deep)
        if depth >= least:
            if open_ and open_[-1][0] == depth:
                current = merged(open_.pop()[1], current, depth)
            open_.append((depth, current))
        current = [position]
    while open_:
        deep, held = open_.pop()
        current = merged(held, current, deep)
    return found


def find_runs(numbers: np.ndarray, starts: np.ndarray, least_words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """(runs as rows of start, length and period, by start and period; text of each) of numbered words; starts count from the text's first word."""
    areas = _areas(numbers, starts, least_words, periods)
    if not len(areas):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    sizes = areas[:, 1] - areas[:, 0] + 1
    ends = np.cumsum(sizes)
    # Areas one after the other, each followed by a word of its own, which ends all common prefixes.
    offset = np.repeat(areas[:, 0] - (ends - sizes), sizes)
    place = np.arange(int(ends[-1])) + offset
    words = np.append(numbers, -1)[np.minimum(place, len(numbers))]
    words[ends - 1] = -2 - np.arange(len(areas))
    text = np.searchsorted(starts, areas[:, 0], side="right") - 1
    before = np.where(place > 0, numbers[np.maximum(place - 1, 0)], -1)
    # Nothing stands before the first word of a text.
    first_word = np.repeat(starts[text], sizes) == place
    before[first_word] = -1
    order, common = _suffixes(words)
    # Positions with no long common prefix on either side are leaves below the root; they drop out of the walk.
    least = least_common(least_words, periods)
    deep = common >= least
    touched = deep | np.append(deep[1:], False)
    pairs = _maximal_pairs(order[touched].tolist(), np.where(deep, common, 0)[touched].tolist(), least, periods, before.tolist()) if touched.any() else []
    found = np.array(pairs, np.int64).reshape(-1, 3)
    found = found[found[:, 1] >= least_words]
    owner = np.repeat(text, sizes)[found[:, 0]]
    found[:, 0] = place[found[:, 0]] - starts[owner]
    rank = np.lexsort((found[:, 2], found[:, 0], owner))
    return found[rank], owner[rank]


def _kept_words(words: list, runs: np.ndarray) -> list:
    """The words that no run repeats: all but those after the first period of a run."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows that are worked on together."""
    first, held = 0, 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > first and held + size > STEP_BYTES:
            yield first, k
            first, held = k, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def _find(least_words: int, periods: int):
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for first, end in _steps(texts):
                # Splits at ASCII white space alone, as bytes know no other.
                words = [(t or b"").split() for t in texts.slice(first, end - first).to_pylist()]
                numbers, starts = word_numbers(words)
                found, owner = find_runs(numbers, starts, least_words, periods)
                bounds = np.searchsorted(owner, np.arange(len(words) + 1))
                collapsed = [b" ".join(_kept_words(w, found[a:b]) if b > a else w) for w, a, b in zip(words, bounds[:-1].tolist(), bounds[1:].tolist())]
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(first, end - first), pa.array([len(w) for w in words], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans).cast(runs_type), pa.array(collapsed, pa.binary()).view(pa.string()),
                ], names=["key", "n_words", "runs", "collapsed"])
    return run


def word_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """Key, `n_words`, `runs` (structs of start, length, period, by start and period) and `collapsed` of every row of `df`.

    Words are runs without ASCII white space. A run is a stretch of at least `least_words` words and `periods` of its
    smallest period that no neighbour extends. `collapsed` holds the words that no run repeats, joined by one space: the
    first period of each run stays unless another run repeats it. Null, empty and blank texts have no words, no runs
    and an empty `collapsed`. Rows are worked on one by one, whatever their keys; an empty table gives no rows; other
    columns are not read.
    """
    if least_words < 1 or periods < 2:
        raise ValueError("runs have a word and two periods at least")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_find(least_words, periods), f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("key", key)


def looped_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, where every tenth text by crc32 of its key goes round in a loop from one of its words on.

    With h = crc32(key) and g = floor(h / 10): if h % 10 = 0 and there are words, word i >= a becomes word a + (i - a) % p,
    where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Rows without a key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    marked = marked.withColumns({"_g": F.expr("_h div 10"), "_n": F.size("_words").cast("long")})
    marked = marked.withColumn("_a", F.when(F.col("_n") > 0, F.pmod("_g", "_n")))
    marked = marked.withColumn("_p", F.when(F.col("_n") > 0, F.expr("1 + (_n - _a) div (3 + _g % 8)")))
    looped = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1).cast("int"))))
    return marked.select(F.col("_key").alias(key), F.when(F.col("_n") > 0, F.concat_ws(" ", looped)).otherwise(F.col("_text")).alias(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(looped_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Longest in periods first; equal ones by start and period, which is their order.
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda b, r: F.when(b.isNull() | (r["length"].cast("decimal(19,0)") * b["period"] > b["length"].cast("decimal(19,0)") * r["period"]), r).otherwise(b),
    )
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )


#: Runs from every pair of equal words at most a quarter of the text apart: stretches of neighbouring pairs at one distance,
#: and of those with the same start and length the one with the smallest distance.
OP13_SQL = f"""
WITH nibble AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(16) r(i))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(xor(xor(c, b) // 16, t[xor(c, b) % 16 + 1]) // 16, t[xor(xor(c, b) // 16, t[xor(c, b) % 16 + 1]) % 16 + 1]))) AS h
  FROM documents, nibble),
e AS (SELECT *, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM f),
o AS MATERIALIZED (SELECT r, n, i, w[i + 1] AS x FROM t, LATERAL (SELECT unnest(range(n)) AS i) WHERE n >= {LEAST_WORDS}),
m AS (SELECT a.r, a.i, b.i - a.i AS q FROM o a JOIN o b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND {LEAST_PERIODS} * (b.i - a.i) <= a.n),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM m) GROUP BY r, q, part),
runs AS MATERIALIZED (
  SELECT r, start, length, min(q) AS period FROM s WHERE length >= {LEAST_WORDS} AND length >= {LEAST_PERIODS} * q GROUP BY r, start, length),
best AS (SELECT r, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
lines AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT o.r, string_agg(x, ' ' ORDER BY o.i) AS s FROM o LEFT JOIN gone g ON g.r = o.r AND g.i = o.i WHERE g.r IS NULL GROUP BY o.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines.s, '')) AS runs_sha256, sha256(CASE WHEN n < {LEAST_WORDS} THEN array_to_string(w, ' ') ELSE kept.s END) AS collapsed_sha256, n AS n_words
FROM t LEFT JOIN best USING (r) LEFT JOIN lines USING (r) LEFT JOIN kept USING (r)
"""
