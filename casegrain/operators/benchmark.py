"""Retrieval benchmarks from a labelled corpus: queries and judgments.

Document ids are taken to be unique, which the quality gates check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.operators.ranking import first_per_group, sample_per_group, sample_rows
from casegrain.operators.scaling import is_small, join_hot
from casegrain.sources import writers
from casegrain.workspace import written


@dataclass(frozen=True)
class Benchmark:
    """Search documents, queries (both with the source columns) and judgments."""

    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame

    def save(self, path: str) -> None:
        writers.write_json_lines(writers.search_documents(self.documents), f"{path}/corpus.jsonl")
        writers.write_json_lines(writers.search_queries(self.queries), f"{path}/queries.jsonl")
        writers.write_qrels(self.qrels, f"{path}/qrels.jsonl")


def same_category(
    corpus: DataFrame, queries: DataFrame, cap: int = fixed.JUDGMENTS_PER_QUERY
) -> DataFrame:
    """Up to ``cap`` other documents of the query's category, relevance 1.

    The first ``cap + 1`` documents of a category hold the first ``cap`` others
    of any of its queries, so only they are joined.
    """
    docs = corpus.select("primary_category", F.col("complaint_id").alias("doc_id"))
    first = first_per_group(docs, ["primary_category"], ["doc_id"], cap + 1)
    asked = queries.select("primary_category", F.col("complaint_id").alias("qid"))
    pairs = asked.join(first, "primary_category").where("qid <> doc_id")
    return first_per_group(pairs, ["qid"], ["doc_id"], cap).select(
        "qid", "doc_id", F.lit(1).cast("bigint").alias("rel")
    )


def graded(
    corpus: DataFrame, queries: DataFrame, cap: int = fixed.GRADED_CATEGORY_CAP
) -> DataFrame:
    """Relevance 2 for the same category and issue, 1 for up to ``cap`` others.

    All documents of the same issue are judged; a document without an issue is
    of no issue. The others come from a short list per category: the first
    ``cap + 1`` of each issue, of these the first ``2 * cap + 1``, which hold
    the first ``cap`` others outside any one issue.
    """
    docs = corpus.select(
        "primary_category", "original_issue", F.col("complaint_id").alias("doc_id")
    )
    asked = queries.select(
        "primary_category", F.col("original_issue").alias("q_issue"),
        F.col("complaint_id").alias("qid"),
    )
    asked = written(asked, "asked")
    small = is_small(asked)
    # Category and issue as one key; a null in either gives no key and no match.
    pair = lambda issue: F.concat("primary_category", F.lit("\u0001"), issue)
    same_issue = (
        join_hot(
            docs.select(pair("original_issue").alias("_pair"), "doc_id"),
            asked.select(pair("q_issue").alias("_pair"), "qid"), "_pair", "doc_id", small=small,
        )
        .where("qid <> doc_id")
        .select("qid", "doc_id", F.lit(2).cast("bigint").alias("rel"))
    )
    per_issue = first_per_group(docs, ["primary_category", "original_issue"], ["doc_id"], cap + 1)
    short_list = first_per_group(per_issue, ["primary_category"], ["doc_id"], 2 * cap + 1)
    others = (
        join_hot(asked, written(short_list, "short-list"), "primary_category", "qid")
        .where("qid <> doc_id and coalesce(original_issue <> q_issue, true)")
    )
    return same_issue.unionByName(
        first_per_group(others, ["qid"], ["doc_id"], cap).select(
            "qid", "doc_id", F.lit(1).cast("bigint").alias("rel")
        )
    )


def build_benchmark(
    corpus: DataFrame, test: DataFrame, per_class: int = fixed.QUERIES_PER_CLASS,
    cap: int = fixed.JUDGMENTS_PER_QUERY, seed: int = fixed.SEED,
) -> Benchmark:
    queries = sample_per_group(test, "primary_category", "complaint_id", per_class, seed)
    return Benchmark(corpus, queries, same_category(corpus, queries, cap))


def build_graded_benchmark(
    corpus: DataFrame, test: DataFrame, n: int = fixed.GRADED_QUERIES,
    cap: int = fixed.GRADED_CATEGORY_CAP, seed: int = fixed.SEED,
) -> Benchmark:
    queries = sample_rows(test, "complaint_id", n, seed)
    return Benchmark(corpus, queries, graded(corpus, queries, cap))
