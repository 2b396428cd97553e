"""Corpus statistics and quality gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.functions import text
from casegrain.operators.splitting import SPLITS
from casegrain.operators.terms import exploded
from casegrain.workspace import written


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, the most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def share_by(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Percent of all rows per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, digits))


def percentiles(
    df: DataFrame, column: str, percents: Sequence[int] = tuple(fixed.WORD_PERCENTILES),
    approximate: bool = False,
) -> DataFrame:
    """Percentiles of a column with linear interpolation.

    Exact ones count each distinct value, which suits word counts; the
    approximate form suits columns with very many values.
    """
    shares = F.array(*[F.lit(p / 100) for p in percents])
    value = (
        F.percentile_approx(column, shares, 10_000).cast("array<double>")
        if approximate
        else F.percentile(column, shares)
    )
    return (
        df.agg(value.alias("_v"))
        .select(F.posexplode("_v").alias("_i", "value"))
        .select(
            F.get(F.array(*[F.lit(p).cast("bigint") for p in percents]), F.col("_i")).alias("percentile"),
            F.round("value", 6).alias("value"),
        )
    )


def length_summary(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """One row; quartiles are exact, or approximate for a column of very many values."""
    at = lambda p: (
        F.percentile_approx(column, F.lit(p), 10_000).cast("double")
        if approximate else F.percentile(column, F.lit(p))
    )
    quartile = lambda p: F.round(at(p), 6)
    return df.agg(
        F.min(column).cast("double").alias("min"),
        quartile(0.25).alias("p25"),
        quartile(0.5).alias("p50"),
        quartile(0.75).alias("p75"),
        F.max(column).cast("double").alias("max"),
        F.round(F.avg(column), 6).alias("mean"),
        F.round(F.stddev(column), 6).alias("stddev"),
    )


def vocabulary_size(df: DataFrame, text_column: str) -> DataFrame:
    words = exploded(df, [], text.tokens(F.col(text_column)), "word")
    return words.agg(F.countDistinct("word").alias("vocabulary"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, in one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column", "nulls")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key; null is one value.

    Long texts are counted by their SHA-256, so that texts need not move.
    """
    groups = df.groupBy(F.sha2(F.col(key).cast("string"), 256)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def histogram(df: DataFrame, column: str, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Rows in each of ``bins`` equal bins from minimum to maximum of an integer column.

    Empty bins are kept. Everything after the first count is small.
    """
    counts = written(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), "histogram")
    low, high = (counts.agg(f(column)).scalar() for f in (F.min, F.max))
    position = F.expr(f"(_value - _low) * {bins} div nullif(_high - _low, 0)")
    placed = counts.select(F.col(column).alias("_value"), low.alias("_low"), high.alias("_high"), "_n")
    bin_of = F.when(F.col("_high") > F.col("_low"), F.least(position, F.lit(bins - 1))).otherwise(bins // 2)
    filled = placed.groupBy((bin_of + 1).cast("bigint").alias("bin")).agg(F.sum("_n").alias("n"))
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return every.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def mask_totals(df: DataFrame, text_column: str = "cleaned_text") -> DataFrame:
    """How often each mask token occurs."""
    sums = df.agg(*[
        F.sum(text.occurrences(F.col(text_column), token)).alias(token) for token in fixed.MASK_TOKENS
    ])
    return sums.unpivot([], [F.col(f"`{t}`") for t in fixed.MASK_TOKENS], "token", "n")


def residual_pii(df: DataFrame, text_column: str = "cleaned_text") -> DataFrame:
    """Rows that still show an e-mail address, a phone or a card number."""
    c = F.col(text_column)
    return df.agg(
        F.count_if(text.has_email(c)).alias("emails"),
        F.count_if(text.has_phone(c)).alias("phones"),
        F.count_if(text.has_card(c)).alias("cards"),
    )


def judgment_summary(qrels: DataFrame) -> DataFrame:
    per_query = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("n").alias("judgments"),
        F.round(F.avg("n"), 6).alias("mean"),
        F.min("n").alias("min"),
        F.max("n").alias("max"),
    )


def split_overlap(split: DataFrame, id_column: str = "complaint_id") -> DataFrame:
    """Keys shared by two splits, summed over the pairs of splits.

    One aggregation: a key in ``m`` splits is shared by ``m * (m - 1) / 2`` pairs.
    """
    held = split.groupBy(id_column).agg(F.countDistinct("split").alias("_m"))
    return held.agg(F.coalesce(F.expr("sum(_m * (_m - 1) div 2)"), F.lit(0)).alias("shared"))


def missing_references(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Judgments whose query or document does not exist."""
    lost = lambda table, key: qrels.join(table.select(key).distinct(), key, "left_anti").agg(
        F.count(F.lit(1)).alias("n")
    )
    return lost(queries, "qid").select(F.lit("query").alias("side"), "n").unionByName(
        lost(docs, "doc_id").select(F.lit("document").alias("side"), "n")
    )


def label_difference(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Labels on one side only; empty when the label sets are equal."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(x,) for x in expected], f"{column} string")
    found = df.select(column).distinct()
    return (
        found.subtract(wanted).select(column, F.lit("unexpected").alias("problem"))
        .unionByName(wanted.subtract(found).select(column, F.lit("missing").alias("problem")))
    )


def validate(
    corpus: DataFrame, split: DataFrame, queries: DataFrame, qrels: DataFrame,
    columns: Sequence[str] = tuple(fixed.CORPUS_COLUMNS),
    min_rows: int = fixed.MIN_CORPUS_ROWS, min_class_rows: int = fixed.MIN_CLASS_ROWS,
    expected_queries: int = fixed.EXPECTED_QUERIES, min_relevance: int = fixed.MIN_RELEVANCE,
    classes: Sequence[str] = tuple(fixed.SEVEN_CLASSES),
) -> DataFrame:
    """One row per gate: ``(gate, status, value)``.

    ``queries(qid)`` and ``qrels(qid, doc_id, rel)`` are the benchmark; corpus
    ids are its documents. The corpus has exactly the ``classes``, every split
    has every class, and every query is judged.
    """
    missing = [c for c in columns if c not in corpus.columns]
    present = [c for c in columns if c in corpus.columns]
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in present])
    cleaned = F.col("cleaned_text")
    basics = corpus.agg(
        F.lit(len(missing)).cast("bigint").alias("missing_columns"),
        nulls.alias("nulls"),
        F.count(F.lit(1)).alias("corpus_rows"),
        F.count_if(text.has_email(cleaned)).alias("emails"),
        F.count_if(text.has_phone(cleaned)).alias("phones"),
        F.count_if(text.has_card(cleaned)).alias("cards"),
    )
    smallest = corpus.groupBy("primary_category").agg(F.count(F.lit(1)).alias("_n"))
    judgments = qrels.agg(
        F.count(F.lit(1)).alias("judgments"),
        F.count_if(F.col("rel") < min_relevance).alias("low_judgments"),
    )
    docs = corpus.select(F.col("complaint_id").alias("doc_id"))
    lost = missing_references(qrels, queries, docs)
    held = split.where(F.col("primary_category").isin(list(classes))).select("primary_category", "split").distinct()
    unjudged = queries.select("qid").distinct().join(qrels.select("qid").distinct(), "qid", "left_anti")
    one = lambda df, name: df.select(*[F.col(c).alias(name) for c in df.columns])
    tables = [
        basics,
        one(duplicates(corpus, "cleaned_text"), "duplicate_texts"),
        one(duplicates(corpus, "complaint_id"), "duplicate_ids"),
        smallest.agg(F.min("_n").alias("smallest_class")),
        one(split_overlap(split), "split_overlap"),
        split.agg(F.count(F.lit(1)).alias("split_rows")),
        queries.agg(F.countDistinct("qid").alias("queries")),
        judgments,
        one(label_difference(corpus, "primary_category", classes).agg(F.count(F.lit(1))), "label_differences"),
        held.agg((F.lit(len(set(classes)) * len(SPLITS)) - F.count(F.lit(1))).alias("classes_not_in_splits")),
        unjudged.agg(F.count(F.lit(1)).alias("unjudged_queries")),
        lost.where("side = 'query'").select(F.col("n").alias("unknown_queries")),
        lost.where("side = 'document'").select(F.col("n").alias("unknown_documents")),
    ]
    long = [t.unpivot([], t.columns, "gate", "value") for t in tables]
    found = reduce(DataFrame.unionByName, long)
    value, gate = F.coalesce("value", F.lit(0)), F.col("gate")
    rows = corpus.agg(F.count(F.lit(1))).scalar()
    passed = (
        F.when(gate == "corpus_rows", value >= min_rows)
        .when(gate == "smallest_class", value >= min_class_rows)
        .when(gate == "queries", value == expected_queries)
        .when(gate == "judgments", value > 0)
        .when(gate == "split_rows", value == rows)
        .otherwise(value == 0)
    )
    return found.select(
        "gate", F.when(passed, "pass").otherwise("fail").alias("status"), value.alias("value")
    )


def require_valid(gates: DataFrame) -> None:
    """Raise with all failed gates."""
    failed = gates.where("status = 'fail'").collect()  # at most one row per gate
    if failed:
        raise ValueError("failed gates: " + ", ".join(f"{g.gate}={g.value}" for g in failed))
