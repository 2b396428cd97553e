"""Similar cases: BM25, TF-IDF cosine and rank fusion.

A ranking is a frame ``(qid, rank, doc_id, score)``. Scores are rounded to six
places before they are ranked, so that equal scores tie whatever the order of
summation was.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.functions import text
from casegrain.operators.features import (
    TfidfModel,
    fit_tfidf,
    long_weights,
    unit_vectors,
    word_table,
)
from casegrain.operators.inverted import (
    Layout,
    Part,
    Search,
    opened,
    planned,
    save_blocks,
    term_sizes,
    write_document_blocks,
)
from casegrain.operators.ranking import first_per_group
from casegrain.operators.ranking import top_k as ranked_top_k
from casegrain.operators.terms import exploded, with_term_counts
from casegrain.workspace import fresh_path, written

SCORE_DIGITS = 6


@dataclass(frozen=True)
class Bm25Index:
    """An inverted index: ``docs(doc_id, len)``, ``terms(term, df, idf, top)``, ``blocks`` and ``stats``.

    ``docs`` has one row per document, empty ones included. ``top`` is the largest impact of a
    term's postings, for the constants that ``stats`` (one row) names along with the counts.
    """

    docs: DataFrame
    terms: DataFrame
    blocks: DataFrame
    stats_row: DataFrame

    @cached_property
    def known(self) -> dict:
        """The stored statistics; no search scans the documents for them."""
        return self.stats_row.first().asDict()

    @property
    def layout(self) -> Layout:
        return Layout(self.known["slices"], self.known["folders"])

    def postings(self) -> DataFrame:
        """``(term, doc_id, tf)``."""
        return _postings_of(self.blocks).select("term", "doc_id", "tf")

    def stats(self) -> DataFrame:
        """One row: number of documents and mean length."""
        return self.stats_row.select("n_docs", "avg_len")

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """Postings of some terms, from the folders that hold them."""
        found = opened(self.blocks, self.layout, asked)
        return _postings_of(found.join(asked.select("term").distinct(), "term", "left_semi"))

    def save(self, path: str, blocks: bool = True) -> None:
        """All parts under one folder, without the blocks if they were built there."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats_row.write.mode("overwrite").parquet(f"{path}/stats")
        if blocks:
            save_blocks(self.blocks, f"{path}/blocks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in ("docs", "terms", "blocks", "stats")))


def _postings_of(blocks: DataFrame) -> DataFrame:
    posting = F.arrays_zip("docs", "values", "lens")
    return exploded(blocks, ["term"], posting, "_p").select(
        "term", F.col("_p.docs").alias("doc_id"), F.col("_p.values").cast("bigint").alias("tf"),
        F.col("_p.lens").alias("len"))


def tokenised(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``(doc_id, tokens)``, written, for several indexes of the same documents."""
    return written(docs.select("doc_id", text.tokens(F.col(text_column)).alias("tokens")), "tokens")


def document_terms(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``(doc_id, len, terms)`` of each document, counted inside the row; from its ``tokens`` if they are there."""
    found = F.col("tokens") if "tokens" in docs.columns else text.tokens(F.col(text_column))
    tokens = docs.select("doc_id", found.alias("_tokens"))
    counted = with_term_counts(tokens, F.col("_tokens"))
    return counted.select("doc_id", F.size("_tokens").cast("bigint").alias("len"), "terms")


def saturation(k1: float, b: float, avg_len: float):
    """The impact of a posting: what its term frequency and document length give, without the idf."""

    def impact(tf, length):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))

    return impact


def idf_of(n_docs: int, df):
    return F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_index(
    docs: DataFrame, text_column: str = "text", k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
) -> Bm25Index:
    """Index ``(doc_id, text)``.

    Texts are tokenised once, into one row of counted terms per document. From
    there the documents move to their slices and the blocks to their folders;
    document frequencies are those of the blocks. All parts are written, since
    every search hangs off them.
    """
    return index_of(written(document_terms(docs, text_column), "bm25-docs"), k1, b)


def index_of(
    forward: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, path: str | None = None,
) -> Bm25Index:
    """Index the written rows ``(doc_id, len, terms)`` of :func:`document_terms`; ``path`` is for the blocks."""
    spark = forward.sparkSession
    counts = forward.select("len", F.size("terms").alias("n"))
    n_docs, words, n_postings = counts.agg(F.count(F.lit(1)), F.sum("len"), F.coalesce(F.sum("n"), F.lit(0))).first()
    avg_len = words / n_docs if n_docs else None
    layout = Layout.of(n_docs, n_postings, spark.sparkContext.defaultParallelism)
    impact = saturation(k1, b, avg_len or 1.0)
    blocks = write_document_blocks(forward, "tf", impact, layout, path or fresh_path(spark, "bm25-blocks"))
    terms = term_sizes(blocks).select("term", "df", idf_of(n_docs, F.col("df")).alias("idf"), "top")
    stats = spark.createDataFrame(
        [(n_docs, avg_len, k1, b, layout.slices, layout.folders)],
        "n_docs long, avg_len double, k1 double, b double, slices int, folders int")
    return Bm25Index(forward.select("doc_id", "len"), written(terms, "bm25-terms"), blocks, written(stats, "bm25-stats"))


def query_terms(queries: DataFrame, text_column: str = "text") -> DataFrame:
    """``(qid, term, qtf)``: a term repeated in a query counts each time."""
    counted = with_term_counts(queries.select("qid", text_column), text.tokens(F.col(text_column)))
    return exploded(counted, ["qid"], "terms", "_t").select(
        "qid", "_t.term", F.col("_t.tf").alias("qtf")
    )


def bm25_plan(
    queries: DataFrame, index: Bm25Index, k: int = 10, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
    exclude_self: bool = False, **limits,
) -> Search:
    """The search with the tables that say what it opens; see :mod:`casegrain.operators.inverted`."""
    known = index.known
    weight = F.col("qtf") * F.col("idf")
    # With other constants than the index was built for no impact reaches k1 + 1 either.
    top = F.col("top") if (known["k1"], known["b"]) == (k1, b) else F.lit(k1 + 1.0)
    asked = written(
        query_terms(queries).join(index.terms, "term")
        .select("qid", "term", weight.alias("weight"), (weight * top).alias("most"), "df"),
        "bm25-queries",
    )
    impact = saturation(k1, b, known["avg_len"] or 1.0)
    return planned(asked, [Part(index.blocks, index.layout)], impact, k, exclude_self, **limits)


def bm25_search(
    queries: DataFrame, index: Bm25Index, k: int = 10, k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B, exclude_self: bool = False, **limits,
) -> DataFrame:
    """Top ``k`` documents per query ``(qid, text)``; only documents that match."""
    return _ranked(bm25_plan(queries, index, k, k1, b, exclude_self, **limits).scores, k)


@dataclass(frozen=True)
class TfidfIndex:
    """A fitted model and its documents' unit vectors in blocks, with each term's largest weight."""

    model: TfidfModel
    terms: DataFrame
    blocks: DataFrame
    layout_row: DataFrame

    @cached_property
    def layout(self) -> Layout:
        return Layout(*self.layout_row.first())

    def save(self, path: str) -> None:
        self.model.save(f"{path}/model")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.layout_row.write.mode("overwrite").parquet(f"{path}/layout")
        save_blocks(self.blocks, f"{path}/blocks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfIndex:
        parts = (spark.read.parquet(f"{path}/{part}") for part in ("terms", "blocks", "layout"))
        return cls(TfidfModel.load(spark, f"{path}/model"), *parts)


def _as_is(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return values


def tfidf_index(
    docs: DataFrame, max_features: int = fixed.TFIDF_FEATURES,
    stop_words=tuple(fixed.STOP_WORDS),
) -> TfidfIndex:
    """Fit on ``(doc_id, text)`` and keep the documents' vectors; texts are cut into words once."""
    spark = docs.sparkSession
    words = written(word_table(docs, "text", ["doc_id"], stop_words), "tfidf-words")
    model = fit_tfidf(words, max_features=max_features, min_df=1, stop_words=stop_words)
    vectors = written(unit_vectors(words, model), "tfidf-vectors")
    n_docs, n_postings = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    layout = Layout.of(n_docs, n_postings, spark.sparkContext.defaultParallelism)
    rows = vectors.select("doc_id", F.lit(0).cast("bigint").alias("len"), F.col("vector").alias("terms"))
    blocks = write_document_blocks(rows, "weight", _as_is, layout, fresh_path(spark, "tfidf-blocks"))
    sizes = written(term_sizes(blocks), "tfidf-terms")
    row = spark.createDataFrame([(layout.slices, layout.folders)], "slices int, folders int")
    return TfidfIndex(model, sizes, blocks, written(row, "tfidf-layout"))


def tfidf_rank(
    queries: DataFrame, index: TfidfIndex, k: int = 10, exclude_self: bool = False, **limits,
) -> DataFrame:
    """Top ``k`` documents by cosine; a search opens blocks of its terms only."""
    asked_words = word_table(queries, "text", ["qid"], index.model.stop_words)
    asked = written(
        long_weights(unit_vectors(asked_words, index.model)).join(index.terms, "term")
        .select("qid", "term", "weight", (F.col("weight") * F.col("top")).alias("most"), "df"),
        "tfidf-queries",
    )
    search = planned(asked, [Part(index.blocks, index.layout)], _as_is, k, exclude_self, **limits)
    return _ranked(search.scores, k).where("score > 0")


def tfidf_search(
    queries: DataFrame, docs: DataFrame, k: int = 10,
    max_features: int = fixed.TFIDF_FEATURES, exclude_self: bool = False,
    stop_words=tuple(fixed.STOP_WORDS),
) -> DataFrame:
    """Fit on the documents, then the top ``k`` of each query by cosine."""
    return tfidf_rank(queries, tfidf_index(docs, max_features, stop_words), k, exclude_self)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return ranked_top_k(scores.withColumn("score", F.round("score", SCORE_DIGITS)), k)


def fuse(
    sparse: DataFrame, dense: DataFrame, k: int = 10, rrf_k: int = fixed.RRF_K,
    candidates: int = fixed.RRF_CANDIDATES,
) -> DataFrame:
    """Reciprocal rank fusion of two rankings.

    Equal fused scores keep the order of the sparse list, then of the dense one.
    """
    none = F.lit(None).cast("bigint")
    lists = sparse.where(F.col("rank") <= candidates).select(
        "qid", "doc_id", F.col("rank").alias("s"), none.alias("d")
    ).unionByName(
        dense.where(F.col("rank") <= candidates).select(
            "qid", "doc_id", none.alias("s"), F.col("rank").alias("d")
        )
    )
    merged = lists.groupBy("qid", "doc_id").agg(F.max("s").alias("s"), F.max("d").alias("d"))
    share = lambda rank: F.coalesce(1.0 / (rrf_k + F.col(rank)), F.lit(0.0))
    fused = merged.withColumn("score", share("s") + share("d"))
    order = [F.col("score").desc(), F.col("s").asc_nulls_last(), F.col("d")]
    return first_per_group(fused, ["qid"], order, k, rank="rank").select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "doc_id",
        F.round("score", SCORE_DIGITS).alias("score"),
    )
