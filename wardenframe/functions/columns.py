"""Column expressions: casts that never raise, guarded ratios, flags and ranked severities.

Sessions run with ANSI on, so every division and cast here is the ``try_`` form.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings accepted as true, and spellings of a missing key.
TRUE_WORDS = ("1", "true", "yes", "y")
TRUE_WORDS_WITH_ANOMALY = (*TRUE_WORDS, "anomaly")
TRUE_WORDS_WITH_DETECTED = (*TRUE_WORDS_WITH_ANOMALY, "detected")
MISSING_KEY_WORDS = ("nan", "None", "NaN")
SUPPRESSION_TOKENS = ("*", "**", "***")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(flags: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, flags, F.lit(False))


def total(parts: Iterable[Column]) -> Column:
    return functools.reduce(operator.add, parts)


def flag(predicate: Column) -> Column:
    """Predicate with NULL read as false."""
    return F.coalesce(predicate, F.lit(False))


def as_int(predicate: Column) -> Column:
    return flag(predicate).cast("int")


def is_blank(c: str | Column) -> Column:
    """NULL, empty or white space only."""
    return col(c).isNull() | (F.trim(col(c)) == "")


# What counts as numeric text and as a calendar date.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def to_number(c: str | Column) -> Column:
    """Trimmed text to double; anything that is not a plain finite number becomes NULL."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text).try_cast("double")


def strict_date(c: str | Column) -> Column:
    """Year-month-day with dashes; anything else, white space included, is NULL."""
    text = col(c)
    return F.try_to_timestamp(F.when(text.rlike(DATE_PATTERN), text), F.lit("yyyy-M-d")).cast("date")


def finite(c: str | Column) -> Column:
    """Double with NaN and infinities replaced by NULL."""
    value = col(c)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def parse_bool(c: str | Column, words: Sequence[str] = TRUE_WORDS) -> Column:
    """Loose boolean: known true words are true, everything else (NULL too) is false."""
    return flag(F.lower(F.trim(col(c).cast("string"))).isin(*words))


def clean_key(c: str | Column) -> Column:
    """Join key as trimmed text with the usual spellings of missing turned into ''."""
    text = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(text.isin(*MISSING_KEY_WORDS), "").otherwise(text)


def round_decimal(value: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value, so that binary noise in a sum cannot turn a tie."""
    return F.round(value.cast("decimal(20,9)"), digits).cast("double")


def positive_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """n / d where d > 0, else NULL."""
    d = col(denominator)
    return F.when(d > 0, F.try_divide(col(numerator), d))


def plain_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """n / d for any non-zero d; NULL instead of infinity."""
    return F.try_divide(col(numerator), col(denominator))


def relative_change(current: str | Column, previous: str | Column, guarded: bool = True) -> Column:
    """(current - previous) / previous; ``guarded`` asks for a positive base."""
    base = col(previous)
    change = F.try_divide(col(current) - base, base)
    return F.when(base > 0, change) if guarded else change


def ratio_family(name: str, numerator: str, denominator: str, upper: float = 1.0) -> list[Column]:
    """Raw ratio, out-of-range flag, missing flag and the ratio kept only where it is in range.

    Written as SQL text: a feature layout holds hundreds of these columns, and one parsed expression
    is far cheaper to build from Python than a tree of calls.
    """
    n, d = numerator, denominator
    raw = f"CASE WHEN {d} > 0 THEN try_divide({n}, {d}) END"
    outside = f"({raw}) < 0" if upper == float("inf") else f"({raw}) NOT BETWEEN 0 AND {upper}"
    return [
        F.expr(f"{raw} AS {name}_raw"),
        F.expr(f"CAST(coalesce({outside}, false) AS INT) AS {name}_invalid_flag"),
        F.expr(f"CAST({n} IS NULL OR {d} IS NULL OR coalesce({d} <= 0, false) AS INT) AS {name}_missing_flag"),
        F.expr(f"CASE WHEN NOT coalesce({outside}, false) THEN {raw} END AS {name}"),
    ]


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Sum over the given columns of a row; NULL only when all are NULL."""
    parts = [col(c) for c in cols]
    return F.when(any_of(p.isNotNull() for p in parts), total(F.coalesce(p, F.lit(0.0)) for p in parts))


def null_count(cols: Sequence[str | Column]) -> Column:
    return total(col(c).isNull().cast("int") for c in cols)


def exceeds_flag(left: str | Column, right: str | Column) -> Column:
    return as_int(col(left) > col(right))


def lookup(mapping: Mapping[str, str], key: Column, default: Column | None = None) -> Column:
    """Small constant dictionary applied to a column."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def numeric_lookup(mapping: Mapping[str, float], key: Column, default: float) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(float(default)))


def severity_rank(severity: str | Column, order: Sequence[str]) -> Column:
    """Position of a severity in ``order`` (0 = weakest); unknown text ranks 0."""
    ranks = F.lit(0)
    for position, name in enumerate(order):
        if position:
            ranks = F.when(col(severity) == name, position).otherwise(ranks)
    return ranks


def highest_severity(severities: Column, order: Sequence[str]) -> Column:
    """Strongest name in an array column, ``order[0]`` when the array is empty."""
    rank = F.array_max(F.transform(severities, lambda s: severity_rank(s, order)))
    return F.element_at(F.array(*[F.lit(n) for n in order]), F.coalesce(rank, F.lit(0)) + 1)


def tiers(value: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First step whose lower limit the value reaches; ``steps`` run from high to low."""
    out = None
    for limit, result in steps:
        out = F.when(value >= limit, result) if out is None else out.when(value >= limit, result)
    return out.otherwise(otherwise)


def join_present(separator: str, parts: Sequence[tuple[Column, str | Column]]) -> Column:
    """``concat_ws`` over the texts whose predicate holds."""
    return F.concat_ws(separator, *[F.when(p, F.lit(t) if isinstance(t, str) else t) for p, t in parts])


def title_words(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def with_scalars(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row result (a global aggregate) as struct column ``name`` of constants.

    The row is fetched first, as any ``fit`` does: its width is the number of statistics, whatever the
    size of the table. Constants fold into the expressions that read them, so filters on derived
    columns push down without dragging a subquery along, and no join is needed.
    """
    row = one_row.first()
    fields = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields]
    return df.withColumn(name, F.struct(*fields))


def compute_once(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Evaluate SQL columns exactly once per row.

    A filter or projection on top of wide expressions is otherwise rewritten in terms of their inputs,
    copying the whole expression at every use. Unpacking a one-element array keeps them apart.
    """
    return df.selectExpr(*keep, f"inline(array(named_struct({', '.join(columns)})))")


def pin(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row (see ``compute_once``)."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def unpivot_numeric(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """Long form (keys, name, value) of numeric columns; a narrow map, no shuffle."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), list(cols), name, value)


def wide_to_rows(one_row: DataFrame, cols: Sequence[str], measures: Sequence[str], types: Mapping[str, str], name: str = "column_name") -> DataFrame:
    """Turn a one-row aggregate with fields ``<column>__<measure>`` into one row per column."""
    rows = F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"{c}__{m}").cast(types[m]).alias(m) for m in measures]) for c in cols
    ])
    return one_row.select(F.explode(rows).alias("r")).select("r.*")
