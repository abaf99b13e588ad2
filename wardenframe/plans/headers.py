"""Header matching queries over a column catalogue derived from the orders table.

Every order stands for one landed file. Its header is one of four kinds, written in varying
spellings and with columns dropped, by key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenframe.operators import contracts as ct
from wardenframe.plans.registry import query
from wardenframe.sources.tables import read_table

CONTRACTS = (ct.CLAIMS, ct.PHARMACY)
#: Orders that one task turns into headers, about eight rows each.
ORDERS_PER_TASK = 250_000


def _spellings(name: str, alias: str) -> tuple[str, str, str, str]:
    """As declared, first alias, spaced title case, and with a letter lost near the end."""
    return name, alias, name.replace("_", " ").title(), name[:-2] + name[-1:]


def header_rows() -> list[tuple[int, int, str, str, str, str]]:
    rows = []
    for family, contract in enumerate(CONTRACTS):
        for pos, c in enumerate(contract.required):
            rows.append((family, pos, *_spellings(c, contract.aliases[c][0])))
    rows.append((0, len(ct.CLAIMS.required), *(["claim_no"] * 4)))
    for pos, c in enumerate(ct.PRESCRIBER_EXPECTED):
        rows.append((2, pos, c, ct.PRESCRIBER_ALIASES[c][1], c, c.lower().replace("_", "-")))
    for pos, c in enumerate(("page", "visit count", "bounce-rate", "duration", "country")):
        rows.append((3, pos, *([c] * 4)))
    return rows


CATALOGUE_SQL = (
    "headers(family, pos, v0, v1, v2, v3) AS (VALUES "
    + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in header_rows())
    + "),\nlanded AS (SELECT concat('file-', CAST(o_orderkey AS VARCHAR)) AS file_id, CAST(h.pos AS INT) AS pos, "
    "CASE (o_orderkey + h.pos) % 4 WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END AS column_name "
    "FROM orders JOIN headers h ON h.family = o_orderkey % 4 WHERE (o_orderkey * 3 + h.pos * 7) % 10 >= o_orderkey % 8)"
)


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = spark.createDataFrame(header_rows(), "family int, pos int, v0 string, v1 string, v2 string, v3 string")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    tasks = -(-orders.count() // ORDERS_PER_TASK)
    if tasks > 1:
        orders = orders.repartition(tasks, "o_orderkey")
    files = orders.join(F.broadcast(headers), F.col("family") == F.col("o_orderkey") % 4)
    return files.where("(o_orderkey * 3 + pos * 7) % 10 >= o_orderkey % 8").selectExpr(
        "concat('file-', CAST(o_orderkey AS STRING)) AS file_id",
        "pos",
        "CASE (o_orderkey + pos) % 4 WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END AS column_name",
    )


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(column_name)), '[\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"

_VOCAB = "vocab(schema, known, canonical) AS (VALUES " + ", ".join(f"('{s}', '{k}', '{c}')" for s, k, c in ct.vocabulary(CONTRACTS)) + ")"

# Similar names by edit distance; in this catalogue no column ever needs its second choice.
RESOLVED_SQL = (
    "WITH " + CATALOGUE_SQL + ",\n" + _VOCAB + f",\nnamed AS (SELECT *, {_NORM} AS norm FROM landed),\n"
    "hits AS (SELECT n.*, v.schema, v.canonical, row_number() OVER (PARTITION BY file_id, schema, canonical ORDER BY pos) AS r FROM named n JOIN vocab v ON n.norm = v.known),\n"
    "claimed AS (SELECT * FROM hits WHERE r = 1),\n"
    "names AS (SELECT DISTINCT norm FROM named),\n"
    "sims AS (SELECT norm, schema, canonical, known, 1 - levenshtein(norm, known) / greatest(length(norm), length(known)) AS score FROM names, vocab),\n"
    "close AS (SELECT norm, schema, canonical, score, known FROM sims WHERE score >= 0.82),\n"
    "offers AS (SELECT n.file_id, n.pos, n.column_name, s.schema, s.canonical, s.score, row_number() OVER (PARTITION BY n.file_id, n.pos, s.schema ORDER BY s.score DESC, s.known DESC) AS choice "
    "FROM named n JOIN close s ON n.norm = s.norm "
    "WHERE NOT EXISTS (SELECT 1 FROM claimed c WHERE c.file_id = n.file_id AND c.schema = s.schema AND c.pos = n.pos) "
    "AND NOT EXISTS (SELECT 1 FROM claimed c WHERE c.file_id = n.file_id AND c.schema = s.schema AND c.canonical = s.canonical)),\n"
    "firsts AS (SELECT *, row_number() OVER (PARTITION BY file_id, schema, canonical ORDER BY pos) AS r FROM offers WHERE choice = 1),\n"
    "resolved AS (SELECT file_id, schema, pos, column_name, canonical, CASE WHEN norm = canonical THEN 'exact' ELSE 'alias' END AS method, 1.0::DOUBLE AS confidence FROM claimed "
    "UNION ALL SELECT file_id, schema, pos, column_name, canonical, 'fuzzy', round(score, 3) FROM firsts WHERE r = 1)"
)
_SIZES = " UNION ALL ".join(f"SELECT '{k.name}' AS schema, {len(k.required)} AS required" for k in CONTRACTS)
SCORED_SQL = (
    RESOLVED_SQL + f",\nsizes AS ({_SIZES}),\n"
    "scored AS (SELECT f.file_id, z.schema, coalesce(m.matched, 0) AS matched, CAST(z.required AS INT) AS required, round(coalesce(m.matched, 0) / z.required, 3) AS score "
    "FROM (SELECT DISTINCT file_id FROM landed) f, sizes z LEFT JOIN (SELECT file_id, schema, count(DISTINCT canonical) AS matched FROM resolved GROUP BY ALL) m "
    "ON m.file_id = f.file_id AND m.schema = z.schema)"
)


@query("header_name_normalisation", "B1", "WITH " + CATALOGUE_SQL + f" SELECT file_id, pos, column_name, {_NORM} AS normalised FROM landed")
def header_name_normalisation(spark, sf_dir):
    return landed(spark, sf_dir).withColumn("normalised", ct.normalise_name(F.col("column_name")))


@query("header_resolution", "B2", RESOLVED_SQL + " SELECT * FROM resolved")
def header_resolution(spark, sf_dir):
    return ct.resolve_columns(landed(spark, sf_dir), CONTRACTS, similarity="edit")


@query("header_resolution_by_blocks", "B2")
def header_resolution_by_blocks(spark, sf_dir):
    """The default similarity (matching blocks), which SQL cannot state; tested against brute force."""
    return ct.resolve_columns(landed(spark, sf_dir), CONTRACTS)


@query("contract_scores", "B3", SCORED_SQL + " SELECT * FROM scored")
def contract_scores(spark, sf_dir):
    catalogue = landed(spark, sf_dir)
    return ct.score_contracts(catalogue, ct.resolve_columns(catalogue, CONTRACTS, similarity="edit"), CONTRACTS)


@query(
    "contract_detection", "B4",
    SCORED_SQL + " SELECT file_id, CASE WHEN score >= 0.6 THEN schema END AS matched_schema, score AS confidence FROM "
    "(SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, schema) AS r FROM scored) WHERE r = 1",
)
def contract_detection(spark, sf_dir):
    return ct.detect_contract(contract_scores(spark, sf_dir))


_STRICT = sorted({(a.strip().lower().replace(" ", "_").replace("-", "_"), c) for c, known in ct.PRESCRIBER_ALIASES.items() for a in known})


@query(
    "strict_alias_map", "B5",
    "WITH " + CATALOGUE_SQL + ",\nstrict(known, canonical) AS (VALUES " + ", ".join(f"('{k}', '{c}')" for k, c in _STRICT) + "),\n"
    "mapped AS (SELECT l.file_id, s.canonical, count(*) AS n FROM landed l LEFT JOIN strict s ON s.known = replace(replace(lower(trim(column_name)), ' ', '_'), '-', '_') GROUP BY ALL),\n"
    "per_file AS (SELECT file_id, count(*) FILTER (canonical IS NOT NULL AND n > 1) AS conflicts, coalesce(CAST(sum(n) FILTER (canonical IS NULL) AS BIGINT), 0) AS unmapped, "
    f"{len(ct.PRESCRIBER_REQUIRED)} - count(*) FILTER (canonical IN ({', '.join(repr(c) for c in ct.PRESCRIBER_REQUIRED)})) AS missing_required FROM mapped GROUP BY file_id) "
    "SELECT *, CASE WHEN conflicts > 0 THEN 'CONFLICT' WHEN missing_required > 0 THEN 'INCOMPLETE' ELSE 'MATCH' END AS outcome FROM per_file",
)
def strict_alias_map(spark, sf_dir):
    return ct.strict_alias_report(landed(spark, sf_dir), ct.PRESCRIBER_ALIASES, ct.PRESCRIBER_REQUIRED)


@query(
    "dataset_recognition", "B6 J10",
    "WITH " + CATALOGUE_SQL + f", f AS (SELECT file_id, count(DISTINCT CASE WHEN column_name IN ({', '.join(repr(c) for c in ct.PRESCRIBER_INDICATORS)}) THEN column_name END) AS indicators_found FROM landed GROUP BY file_id) "
    "SELECT *, indicators_found >= 6 AS recognised FROM f",
)
def dataset_recognition(spark, sf_dir):
    return ct.recognise(landed(spark, sf_dir), ct.PRESCRIBER_INDICATORS, ct.MIN_INDICATORS)


@query(
    "header_differences", "B7",
    "WITH " + CATALOGUE_SQL + f", want AS (SELECT unnest([{', '.join(repr(c) for c in ct.PRESCRIBER_EXPECTED)}]) AS column_name), files AS (SELECT DISTINCT file_id FROM landed) "
    "SELECT f.file_id, w.column_name, 'missing' AS finding FROM files f, want w WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE l.file_id = f.file_id AND l.column_name = w.column_name) "
    "UNION ALL SELECT DISTINCT file_id, column_name, 'unexpected' FROM landed WHERE column_name NOT IN (SELECT column_name FROM want)",
)
def header_differences(spark, sf_dir):
    return ct.header_differences(landed(spark, sf_dir), ct.PRESCRIBER_EXPECTED)
