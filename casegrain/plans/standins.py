"""The given tables in the roles of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.functions import text
from casegrain.operators.ranking import sample_per_group
from casegrain.operators.splitting import stratified_split
from casegrain.operators.terms import computed_once
from casegrain.workspace import read_table, spread, written


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table for heavy text work, scanned for the named columns only."""
    table = read_table(spark, folder, name)
    return spread(table.select(*columns) if columns else table)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return texts(spark, folder, "documents", *columns)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as corpus rows: language as category, source as issue."""
    rows = documents(spark, folder, "doc_id", "source", "lang", "text").select(
        F.col("doc_id").cast("string").alias("complaint_id"),
        "source",
        F.col("lang").alias("primary_category"),
        F.col("source").alias("original_issue"),
        F.col("text").alias("raw_text"),
    )
    cleaned = computed_once(rows, "cleaned_text", text.clean(F.col("raw_text")))
    return cleaned.withColumn("word_count", text.word_count(F.col("cleaned_text")))


def kept_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus, written once since several plans hang off it."""
    return written(corpus(spark, folder), "corpus")


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus rows without their texts."""
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("complaint_id"),
        F.col("lang").alias("primary_category"),
        F.col("source").alias("original_issue"),
        "source",
    )


def split_keys(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_split(keys(spark, folder))


def test_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark queries: 50 test rows per class."""
    test = split_keys(spark, folder).where("split = 'test'")
    return sample_per_group(test, "primary_category", "complaint_id", 50)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned documents as cases ``(doc_id, text, category, source)``."""
    rows = documents(spark, folder, "doc_id", "text", "lang", "source").select(
        "doc_id", "text", F.col("lang").alias("category"), "source"
    )
    return computed_once(rows, "text", text.clean(F.col("text")))


def narratives(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark passages as narratives ``(qid, text)``."""
    return read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"), "text"
    )
