"""Sinks: tables, search corpora, queries, judgments, result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.operators.scaling import join_hot
from casegrain.sources.commits import CommitList
from casegrain.sources.readers import CSV_OPTIONS
from casegrain.workspace import written

JUDGMENTS_PER_LINE = 1000
#: Queries whose judgments share a file that is one object.
QUERIES_PER_OBJECT = 100


def write_table(df: DataFrame, path: str, csv: bool = True) -> None:
    """Parquet at ``path.parquet`` and, if wanted, CSV at ``path.csv``."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    if csv:
        options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("multiLine", "maxCharsPerColumn")}
        df.write.mode("overwrite").options(**options).option("header", True).csv(f"{path}.csv")


def write_sms(df: DataFrame, path: str) -> None:
    """Headerless tab-separated ``label, text``."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("multiLine", "maxCharsPerColumn")}
    df.select("label", "text").write.mode("overwrite").options(**options).csv(path, sep="\t")


def search_documents(corpus: DataFrame) -> DataFrame:
    """Corpus rows as ``{_id, title, text, metadata}``."""
    metadata = ["source"] + (["original_issue"] if "original_issue" in corpus.columns else [])
    return corpus.select(
        F.col("complaint_id").cast("string").alias("_id"),
        F.col("primary_category").cast("string").alias("title"),
        F.col("cleaned_text").cast("string").alias("text"),
        F.struct(*[F.col(c).cast("string").alias(c) for c in metadata]).alias("metadata"),
    )


def search_queries(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("complaint_id").cast("string").alias("_id"),
        F.col("cleaned_text").cast("string").alias("text"),
    )


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _qrels_parts(qrels: DataFrame, per_line: int) -> DataFrame:
    """``qid, line, docs``: each query's judgments as maps, a bounded number per line."""
    lines = qrels.groupBy("qid").agg(F.ceil(F.count(F.lit(1)) / per_line).alias("lines"))
    return (
        join_hot(qrels, written(lines, "qrels-lines"), "qid", "doc_id")
        .withColumn("line", F.pmod(F.xxhash64("doc_id"), F.col("lines")))
        .groupBy("qid", "line")
        .agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "rel"))).alias("docs"))
    )


def qrels_lines(qrels: DataFrame, per_line: int = JUDGMENTS_PER_LINE) -> DataFrame:
    """Long pairs as maps ``{qid: {doc_id: rel}}``, a bounded number per line.

    A query with many judgments goes over several lines, so that no line (and
    no task) has to hold all judgments of a hot query.
    """
    return _qrels_parts(qrels, per_line).select("qid", F.create_map("qid", "docs").alias("judged"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels_lines(qrels).select(F.to_json("judged")).write.mode("overwrite").text(path)


def write_qrels_objects(
    qrels: DataFrame, path: str, per_line: int = JUDGMENTS_PER_LINE, queries: int = QUERIES_PER_OBJECT,
) -> None:
    """All judgments as files that are one JSON object each, over many lines.

    An object has one line's share of about ``queries`` queries, so that neither
    an object nor a task grows with the judgments.
    """
    parts = written(_qrels_parts(qrels, per_line), "qrels-parts")
    groups = max(1, -(-parts.select("qid").distinct().count() // queries))
    part = F.col("line") * groups + F.pmod(F.xxhash64("qid"), F.lit(groups))
    objects = parts.groupBy(part.alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct("qid", "docs"))).alias("judged"))
    pretty = F.regexp_replace(F.to_json("judged"), r"\},", "},\n")
    objects.select("part", pretty.alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def upserted(existing: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows with the same key."""
    if existing is None:
        return new
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a result table, if there is one."""
    _, content = CommitList(spark, path).newest()
    return None if content is None else spark.read.parquet(f"{path}/tables/{content['table']}")


def upsert_results(new: DataFrame, path: str, key: str = "model", tries: int = 20) -> int:
    """Write the next version of a result table; gives its number.

    A version is a table of its own and a commit that names it. Readers take the newest, so a
    table is never overwritten while it is read and a lost job leaves the old one in place. Of
    two writers at once the second finds the number taken, merges into what the first has
    written and tries the next one, so no rows are lost.
    """
    spark, commits = new.sparkSession, CommitList(new.sparkSession, path)
    for _ in range(tries):
        number, content = commits.newest()
        existing = None if content is None else spark.read.parquet(f"{path}/tables/{content['table']}")
        name = uuid.uuid4().hex
        upserted(existing, new, key).write.parquet(f"{path}/tables/{name}")
        if commits.create(number + 1, {"table": name}):
            return number + 1
    raise RuntimeError(f"{path}: other writers came first {tries} times")
