"""File scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that may wrap the record list of a JSON document.
WRAPPER_KEYS = ("records", "data", "claims", "pharmacy", "items")


# Cell texts that stand for a missing value in a text file.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv_text(spark: SparkSession, path: str | list[str], missing: Sequence[str] = MISSING_WORDS, file_column: str | None = None) -> DataFrame:
    """CSV with every column as text, so leading zeros survive; missing-value words become NULL."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"').csv(path)
    found = [F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) if missing else F.col(f"`{c}`") for c in df.columns]
    return df.select(*found, *([F.col("_metadata.file_path").alias(file_column)] if file_column else []))


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types that fails on a malformed line."""
    return spark.read.option("header", True).option("inferSchema", True).option("mode", "FAILFAST").csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _record_fields(schema: T.StructType) -> list[str]:
    """Field names of the records inside the wrappers, and of unwrapped records."""
    names: dict[str, None] = {}
    for f in schema.fields:
        if f.name in WRAPPER_KEYS and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            names.update(dict.fromkeys(x.name for x in f.dataType.elementType.fields))
        else:
            names.setdefault(f.name)
    return list(names)


def read_json_records(spark: SparkSession, path: str | list[str], multi_line: bool = True, file_column: str | None = None) -> DataFrame:
    """JSON documents to text records: the list under a known wrapper key, else the document itself.

    The first wrapper key that holds a list wins. Scalars keep their text form.
    """
    docs = spark.read.option("multiLine", multi_line).option("primitivesAsString", True).json(path)
    fields = _record_fields(docs.schema)
    types = {f.name: f.dataType for f in docs.schema.fields}
    wrappers = [k for k in WRAPPER_KEYS if isinstance(types.get(k), T.ArrayType) and isinstance(types[k].elementType, T.StructType)]

    def text(source: Column, dtype: T.DataType) -> Column:
        return source if isinstance(dtype, T.StringType) else F.to_json(source)

    def as_record(item: Column, struct: T.StructType) -> Column:
        inner = {f.name: f.dataType for f in struct.fields}
        return F.struct(*[(text(item[n], inner[n]) if n in inner else F.lit(None).cast("string")).alias(n) for n in fields])

    lists = []
    for k in wrappers:
        struct = types[k].elementType
        lists.append(F.transform(F.col(k), _bind(as_record, struct)))
    own = F.array(F.struct(*[
        (text(F.col(n), types[n]) if n in types and n not in wrappers else F.lit(None).cast("string")).alias(n) for n in fields
    ]))
    tag = [F.col("_metadata.file_path").alias(file_column)] if file_column else []
    return docs.select(F.explode(F.coalesce(*lists, own)).alias("r"), *tag).select("r.*", *([file_column] if file_column else []))


def _bind(build, struct):
    def one(item: Column) -> Column:
        return build(item, struct)

    return one


def union_sheets(sheets: Mapping[str, DataFrame], provenance: str = "source_sheet") -> DataFrame:
    """Union by name with a column that tells where a row came from."""
    named = [df.withColumn(provenance, F.lit(name)) for name, df in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def read_years(spark: SparkSession, path: str, years: Sequence[int] | None = None, column: str = "data_year") -> DataFrame:
    """A table partitioned by year; a list of years prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col(column).isin(*years)) if years else df


def with_knowledge_metadata(df: DataFrame, path: Column, root: str, content: str = "content") -> DataFrame:
    """Category (first folder under the root), source (file name) and non-empty trimmed content."""
    tail = F.regexp_replace(path, f"^.*?{root.strip('/')}/", "")
    parts = F.split(tail, "/")
    return df.select(
        F.trim(content).alias("content"),
        F.when(F.size(parts) > 1, parts[0]).otherwise("general").alias("category"),
        F.element_at(parts, -1).alias("source"),
    ).where(F.col("content") != "")


def read_knowledge(spark: SparkSession, root: str, suffixes: Sequence[str] = ("md", "txt")) -> DataFrame:
    """Whole knowledge documents of a folder tree, one row per file."""
    pattern = "*.{" + ",".join(suffixes) + "}"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return with_knowledge_metadata(files.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("p")), F.col("p"), root)
