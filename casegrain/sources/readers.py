"""Scans: delimited text, JSON, Parquet, search corpora, judgments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.sources.delimited import read_delimited

# Quoted fields may span lines and keep their blanks; an empty field is null.
CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "lineSep": "\n",
    "maxCharsPerColumn": "-1",
}

SMS_SCHEMA = "label string, text string"
SEARCH_DOCUMENT_SCHEMA = (
    "_id string, title string, text string,"
    " metadata struct<source: string, original_issue: string>"
)
QUERY_SCHEMA = "_id string, text string"
QRELS_TYPE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType()))


def read_sms(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Headerless tab-separated ``label, text``; ``lines`` as for :func:`read_csv`."""
    if not lines:
        return read_delimited(spark, path, SMS_SCHEMA, "\t")
    return spark.read.options(**CSV_OPTIONS).option("multiLine", False).csv(path, sep="\t", schema=SMS_SCHEMA)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """CSV with a header; every column is a string unless a schema is given.

    Quoted fields may span lines, and a large file is read by many tasks all the same, in two
    passes. ``lines`` says that no field does: then one pass is enough.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("header", True)
    if lines:
        reader = reader.option("multiLine", False)
        return (reader.schema(schema) if schema else reader).csv(path)
    # Without a schema only the header is read here.
    return read_delimited(spark, path, schema or reader.csv(path).schema, header=True)


def read_json(
    spark: SparkSession, path: str, lines: bool, schema: T.StructType | str | None = None
) -> DataFrame:
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """A record file by its suffix: ``.csv``, ``.json`` (whole) or ``.jsonl``."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema)
    if suffix in ("json", "jsonl"):
        return read_json(spark, path, lines=suffix == "jsonl", schema=schema)
    raise ValueError(f"unsupported file format: {path}")


def read_search_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_DOCUMENT_SCHEMA).json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_SCHEMA).json(path)


def read_qrels(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Judgments ``{qid: {doc_id: rel}}`` as long pairs.

    With ``lines`` every line is such an object and a query may go over
    several lines; otherwise the file is one object.
    """
    objects = spark.read.text(path, wholetext=not lines)
    return (
        objects.select(F.from_json("value", QRELS_TYPE).alias("judged"))
        # The outer form keeps Spark from parsing twice to test for emptiness.
        .select(F.explode_outer("judged").alias("qid", "docs"))
        .select("qid", F.explode_outer("docs").alias("doc_id", "rel"))
        .where("doc_id is not null")
    )


def first_rows(df: DataFrame, limit: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``limit`` rows in an explicit order."""
    return df.orderBy(*order).limit(limit)


def read_if_present(
    spark: SparkSession, path: str, reader=read_records
) -> DataFrame | None:
    try:
        return reader(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def discover(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All source tables that exist, by name of column; none is an error."""
    found = [
        df
        for path in paths
        if (df := read_if_present(spark, path, lambda s, p: s.read.parquet(p))) is not None
    ]
    if not found:
        raise FileNotFoundError("no source table found")
    return concatenate(found)


def concatenate(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column a table lacks is null there."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def find_text_column(
    columns: Sequence[str], words: Sequence[str], first_as_default: bool = False
) -> str:
    """The first column whose lowercase name holds one of the words."""
    for column in columns:
        if any(word in column.lower() for word in words):
            return column
    if first_as_default and columns:
        return columns[0]
    raise KeyError(f"no text column among {list(columns)}")


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """Fail before any job when a column is missing."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; at hand: {df.columns}")
    return df
