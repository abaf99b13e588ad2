"""Landing folders with very many files of mixed kinds: one scan per kind, whatever the number of files and headers.

Every record is a map of its cells by the column names of its own file. CSV files are read by position in one scan, and
meet the names of their header, a table with one row per file. JSON files are read as lines, those that hold one
document as a whole by their byte ranges (`json_arrays`). Nothing about single files reaches the driver or the plan: of CSV
headers only the width of the widest is fetched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenframe.session import materialise
from wardenframe.sources.json_arrays import read_json_arrays
from wardenframe.sources.scans import MISSING_WORDS, WRAPPER_KEYS

LANDING_TAGS = ("file", "format", "header")
_CELLS = "map<string,string>"


def _lines(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Lines of the files of a kind with their file and place."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}*")
    place = (F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return reader.text(folder).select("value", F.col("_metadata.file_path").alias("file"), *place)


def _first_lines(lines: DataFrame) -> DataFrame:
    """``(file, line)``: the first line of each file."""
    return lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))


def _column_names(names: Column) -> Column:
    """Names as a CSV scan gives them: places stand for empty names and are added to repeated ones."""
    def name(n: Column, place: Column) -> Column:
        text = F.coalesce(n, F.lit(""))
        repeated = F.size(F.filter(names, lambda x: F.lower(x) == F.lower(n))) > 1
        return F.when(text == "", F.concat(F.lit("_c"), place.cast("string"))).when(repeated, F.concat(n, place.cast("string"))).otherwise(n)
    return F.transform(names, name)


def _separators(line: Column) -> Column:
    """Commas outside quotes."""
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.translate(bare, ",", ""))


def _csv(spark: SparkSession, folder: str, missing: Sequence[str]) -> DataFrame | None:
    first = materialise(_first_lines(_lines(spark, folder, "csv")), "landing-headers")
    columns = (_separators(F.col("line")) + 1).cast("int")
    widest = first.agg(F.max(columns).alias("n")).first()["n"]  # one number
    if widest is None:
        return None
    parsed = F.from_csv("line", ", ".join(f"_c{k} string" for k in range(widest)), {"escape": '"'})
    headers = first.select("file", parsed.alias("p"), columns.alias("n")).select("file", F.slice(F.array(*[F.col(f"p._c{k}") for k in range(widest)]), F.lit(1), F.col("n")).alias("names"))
    headers = materialise(headers.select("file", _column_names(F.col("names")).alias("header")), "landing-headers")
    # One column more than any header has: a cell there belongs to a line that is too long.
    places = [f"_c{k}" for k in range(widest + 1)]
    reader = spark.read.schema(", ".join(f"{c} string" for c in places)).option("header", True).option("enforceSchema", True).option("escape", '"')
    rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").csv(folder).select(F.array(*places).alias("row"), F.col("_metadata.file_path").alias("file"))
    rows = rows.join(headers, "file")
    width = F.size("header")
    surplus = F.exists(F.slice("row", width + 1, F.greatest(F.size("row") - width, F.lit(0))), lambda c: c.isNotNull())
    row = F.transform(F.slice("row", F.lit(1), width), lambda c: F.when(~c.isin(*missing), c) if missing else c)
    too_long = F.raise_error(F.concat(F.lit("a line has more cells than its header in "), F.col("file"))).cast(_CELLS)
    return rows.select("file", F.lit("csv").alias("format"), "header", F.when(surplus, too_long).otherwise(F.map_from_arrays("header", row)).alias("cells"))


def _json(spark: SparkSession, folder: str) -> DataFrame | None:
    lines = _lines(spark, folder, "json")
    # A file whose first line is a document holds one per line; any other is one document as a whole.
    by_line = F.get_json_object("line", "$").isNotNull()
    kinds = materialise(_first_lines(lines).select("file", by_line.alias("by_line")), "landing-kinds")
    if kinds.isEmpty():
        return None
    docs = lines.join(kinds.where("by_line"), "file", "left_semi").where(F.trim("value") != "").select("file", "value")
    as_list, as_map = (lambda text: F.from_json(text, f"array<{_CELLS}>")), F.from_json("value", _CELLS)
    wrapped = F.coalesce(*[F.when(F.ltrim(as_map[k]).startswith("["), as_list(as_map[k])) for k in WRAPPER_KEYS])
    records = F.when(F.ltrim("value").startswith("["), as_list(F.col("value"))).otherwise(F.coalesce(wrapped, F.array(as_map)))
    found = docs.select("file", F.explode(records).alias("cells"))
    whole = kinds.where("NOT by_line")
    if not whole.isEmpty():
        found = found.unionByName(read_json_arrays(spark, folder, "*.json*", files=whole).select("file", F.from_json("record", _CELLS).alias("cells")))
    return found.select("file", F.lit("json").alias("format"), F.lit(None).cast("array<string>").alias("header"), "cells")


def _parquet(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet*").option("mergeSchema", True).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # no file of this kind
            raise
        return None
    nested = (T.StructType, T.ArrayType, T.MapType)
    texts = [(F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")) for f in df.schema.fields]
    cells = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*texts))
    return df.select(F.col("_metadata.file_path").alias("file"), F.lit("parquet").alias("format"), F.lit(None).cast("array<string>").alias("header"), cells.alias("cells"))


def read_landing_cells(spark: SparkSession, folder: str, missing: Sequence[str] = MISSING_WORDS) -> DataFrame:
    """Records of a folder with CSV, JSON and Parquet files: ``file``, ``format``, ``header`` (of CSV files), ``cells``.

    Cells are text, so leading zeros survive; missing-value words of CSV files are NULL. Of JSON documents the records
    under the first wrapper key that holds a list are taken, else the document itself. A CSV line with more cells
    than its file's header is an error; one with fewer lacks them.
    """
    frames = [f for f in (_csv(spark, folder, missing), _json(spark, folder), _parquet(spark, folder)) if f is not None]
    if not frames:
        return spark.createDataFrame([], f"file string, format string, header array<string>, cells {_CELLS}")
    return reduce(DataFrame.unionByName, frames)


def cell_columns(landed: DataFrame) -> DataFrame:
    """``(file_id, pos, column_name)`` of each file: its header, or, in files without one, the names that hold a value."""
    filled = landed.where("header IS NULL").select(F.col("file").alias("file_id"), F.explode("cells").alias("column_name", "value")).where("value IS NOT NULL")
    filled = filled.select("file_id", "column_name").distinct().groupBy("file_id").agg(F.array_sort(F.collect_list("column_name")).alias("names"))
    # The header of a file is the same in all its rows.
    headed = landed.where("header IS NOT NULL").groupBy(F.col("file").alias("file_id")).agg(F.max("header").alias("names"))
    return headed.unionByName(filled).select("file_id", F.posexplode("names").alias("pos", "column_name"))


def as_cells(landed: DataFrame) -> DataFrame:
    """Records of a landing folder in the form of ``read_landing_cells``, from either form."""
    if "cells" in landed.columns:
        return landed
    names = [c for c in landed.columns if c not in LANDING_TAGS]
    return landed.select(*LANDING_TAGS, F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(f"`{c}`") for c in names])).alias("cells"))


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """The same records with a column per name, whatever its case; one that a file lacks is NULL. The names of all columns make the frame's schema."""
    landed = materialise(read_landing_cells(spark, folder), "landing")
    keys = landed.select(F.explode(F.map_keys("cells")).alias("name")).distinct().groupBy(F.lower("name").alias("lower")).agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy("lower").collect()
    texts = [F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in r["names"]]).alias(r["names"][-1]) for r in keys]
    return landed.select(*texts, *LANDING_TAGS)
