"""Quality rules by distribution divergence, in DataFrame functions alone.

A text's histogram of character classes and of its language's common words is compared with the mean
histogram of that language by the Jensen-Shannon distance. A test on too few characters or common words
says nothing, so minimum lengths guard it. Base rules on length and repetition come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.llm.common import WHITE_CLASS, saved, table

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del"],
}
# The classes of characters, as members of a Java character class.
CLASSES = {
    "lower": "a-z",
    "upper": "A-Z",
    "digit": "0-9",
    "stop": ".,;:!?'\"()\\-",
    "symbol": "#*$%&|<>",
}
OTHER = "und"
#: Limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Largest distance to the language's histogram, and the least counts from which it is judged.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.3, 200
MAX_WORD_DISTANCE, MIN_COMMON = 0.45, 20
SMOOTHING = 0.5


def _language(lang: Column | None) -> Column:
    return F.lit(OTHER) if lang is None else F.when(lang.isin(*COMMON_WORDS), lang).otherwise(OTHER)


def text_statistics(df: DataFrame, key: str, text: str, lang: str | None) -> DataFrame:
    """Key, language and all counts of every row; one pass over the texts."""
    rows = df.select(F.col(key).alias("id"), _language(F.col(lang) if lang else None).alias("language"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", f"{WHITE_CLASS}+"), lambda w: w != ""))
    count = F.size("words")
    # Windows of three words as (hash, position): after a sort, equal windows are neighbours.
    windows = F.transform(F.slice("words", 1, F.greatest(count - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))
    longest = max(len(w) for words in COMMON_WORDS.values() for w in words)
    rows = rows.withColumns({
        "n_words": count.cast("long"),
        "windows": F.array_sort(windows),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WHITE_CLASS[1:]}")),
        "short": F.transform(F.filter("words", lambda w: F.length(w) <= longest), F.lower),
    })
    rows = rows.withColumns({
        "hits": F.array_sort(_repeated(F.col("windows"))),
        "common": _by_language(lambda words: F.filter("short", lambda w: w.isin(*words))),
    })
    after = F.slice("hits", 2, F.greatest(F.size("hits"), F.lit(1)))
    # A hit covers three words, but only those before the next hit are counted for it.
    covered = F.aggregate(F.zip_with("hits", after, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda s, x: s + x)
    # Each class is cut out of what the classes before it left, so only the first pass sees the whole text.
    left = [F.col("text")]
    for k, members in enumerate((*CLASSES.values(), WHITE_CLASS[1:-1])):
        rows = rows.withColumn(f"left{k}", F.regexp_replace(left[-1], f"[{members}]+", ""))
        left.append(F.col(f"left{k}"))
    *sizes, blanks = [F.length(before) - F.length(after) for before, after in zip(left, left[1:])]
    found = dict(zip(CLASSES, sizes))
    out = rows.select(
        "id", "language", "n_words", (F.length("text") - blanks).cast("long").alias("word_chars"), found["symbol"].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), *[c.cast("double").alias(name) for name, c in found.items()],
        _by_language(lambda words: F.array(*[_occurrences(w) for w in words])).alias("common"),
    )
    rest = F.greatest(F.col("word_chars").cast("double") - sum((F.col(n) for n in CLASSES), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("classes", F.array(*CLASSES, rest)).drop(*CLASSES)


def _occurrences(word: str) -> Column:
    return F.size(F.filter("common", lambda c: c == word)).cast("double")


def _by_language(make: Callable[[list[str]], Column]) -> Column:
    """What `make` gives for the word list of the row's language; null for other languages."""
    out = F
    for name, words in COMMON_WORDS.items():
        out = out.when(F.col("language") == name, make(words))
    return out


def _repeated(windows: Column) -> Column:
    """Positions of the windows that equal the one before or after them in the sorted array."""
    nexts = F.transform(F.slice(windows, 2, F.greatest(F.size(windows), F.lit(1))), lambda w: w["h"])
    forward = F.zip_with(windows, nexts, lambda w, n: F.struct(w["h"].alias("h"), w["i"].alias("i"), F.coalesce(w["h"] == n, F.lit(False)).alias("again")))
    return F.transform(F.filter(forward, lambda w, k: w["again"] | F.coalesce(F.get(windows, k - 1)["h"] == w["h"], F.lit(False))), lambda w: w["i"])


def _shares(counts: Column) -> Column:
    whole = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(whole > 0, x / whole).otherwise(0.0))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)


def js_distance(left: Column, right: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms of shares: 0 equal, 1 disjoint."""
    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / ((p + q) / 2))).otherwise(0.0)
    terms = F.zip_with(left, right, lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def divergence_rules(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS, min_common: int = MIN_COMMON,
) -> DataFrame:
    """Key, base counts, `class_distance`, `word_distance`, `base_failed` and `kept` of every row.

    A language's histogram is the mean of the shares of all its rows that pass the base rules (each row
    counts once, so a long text does not outweigh others). A distance is null, and passes, where the text
    has fewer than `min_chars` word characters or `min_common` common words, or no row of its language
    passes the base rules. Languages without a word list, and null, share one reference and are judged by
    character classes alone. Null text counts as empty and fails the length rule. Repeated rows are judged
    alike; an empty table gives no rows.
    """
    rows = saved(text_statistics(df, key, text, lang), "text-statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    mean = lambda name, size: F.array(*[F.avg(F.get(_shares(F.col(name)), k)) for k in range(size)])
    passed = rows.filter(~F.col("base_failed"))
    references = passed.groupBy("language").agg(mean("classes", len(CLASSES) + 1).alias("ref_classes"), mean("common", max(map(len, COMMON_WORDS.values()))).alias("ref_common"))
    # One row for each language with a word list and one for all others: bounded by COMMON_WORDS.
    rows = rows.join(F.broadcast(references), "language", "left")
    rows = rows.withColumn("class_distance", F.when(_total(F.col("classes")) >= min_chars, js_distance(_shares(F.col("classes")), F.col("ref_classes"))))
    smooth = F.transform("common", lambda x: x + SMOOTHING)
    rows = rows.withColumn("word_distance", F.when((_total(F.col("common")) >= min_common) & (F.size("common") > 0), js_distance(_shares(smooth), F.col("ref_common"))))
    near = F.coalesce(F.col("class_distance") <= max_class_distance, F.lit(True)) & F.coalesce(F.col("word_distance") <= max_word_distance, F.lit(True))
    return rows.select(F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance")


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _sql() -> str:
    space = "[\\x20\\x09-\\x0D]"
    classes = ", ".join(f"(length(text) - length(regexp_replace(text, '[{m.replace(chr(39), chr(39) * 2)}]+', '', 'g')))::DOUBLE AS {n}" for n, m in CLASSES.items())
    lists = "CASE lang " + " ".join(f"WHEN '{n}' THEN [{', '.join(repr(w) for w in ws)}]" for n, ws in COMMON_WORDS.items()) + " END"
    known = ", ".join(repr(n) for n in COMMON_WORDS)
    size = max(map(len, COMMON_WORDS.values()))
    part = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"

    def distance(left: str, right: str, count: int) -> str:
        pairs = [(f"{left}[{k}]", f"{right}[{k}]") for k in range(1, count + 1)]
        return "sqrt(greatest(" + " + ".join(f"({part.format(p=p, q=q)} + {part.format(p=q, q=p)}) / 2" for p, q in pairs) + ", 0))"

    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({known}) THEN lang ELSE '{OTHER}' END AS language, {lists} AS list,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS words, row_number() OVER () AS r FROM documents),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) AS h FROM w WHERE len(words) > 2),
hit AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, h) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, sum(least(coalesce(nxt - i, 3), 3)) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM hit) GROUP BY r),
s AS (SELECT w.r, doc_id, language, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[{CLASSES["symbol"]}]', '', 'g')))::BIGINT AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space[1:]}')) AS lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, {classes},
             list_transform(list, lambda c: len(list_filter(words, lambda x: lower(x) = c))::DOUBLE) AS common FROM w LEFT JOIN cover USING (r)),
c AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             [{", ".join(CLASSES)}, greatest(word_chars - ({" + ".join(CLASSES)}), 0)] AS classes FROM s),
p AS (SELECT *, CASE WHEN list_sum(classes) > 0 THEN list_transform(classes, lambda x: x / list_sum(classes)) ELSE list_transform(classes, lambda x: 0.0) END AS class_share,
             CASE WHEN list_sum(common) > 0 THEN list_transform(common, lambda x: x / list_sum(common)) ELSE list_transform(common, lambda x: 0.0) END AS common_share,
             list_transform(common, lambda x: (x + {SMOOTHING}) / (list_sum(common) + {SMOOTHING} * len(common))) AS smooth FROM c),
ref AS (SELECT language, [{", ".join(f"avg(class_share[{k}])" for k in range(1, len(CLASSES) + 2))}] AS rc, [{", ".join(f"avg(common_share[{k}])" for k in range(1, size + 1))}] AS rw FROM p WHERE NOT base_failed GROUP BY language)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(CASE WHEN list_sum(classes) >= {MIN_CHARS} THEN {distance("class_share", "rc", len(CLASSES) + 1)} <= {MAX_CLASS_DISTANCE} END, true)
       AND coalesce(CASE WHEN list_sum(common) >= {MIN_COMMON} THEN {distance("smooth", "rw", size)} <= {MAX_WORD_DISTANCE} END, true) AS kept
FROM p LEFT JOIN ref USING (language)
"""


OP7_SQL = _sql()
