"""Triage: clean, classify and look up similar cases for a table of narratives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions import text
from casegrain.operators.classify import TextPipeline, balanced, load_model, predict, save_model
from casegrain.operators.features import ml_vectors
from casegrain.operators.naive_bayes import (
    NaiveBayesModel,
    fit_naive_bayes,
    predict_naive_bayes,
)
from casegrain.operators.retrieval import Bm25Index, bm25_index, bm25_search, fuse
from casegrain.operators.scaling import join_hot
from casegrain.operators.terms import computed_once
from casegrain.workspace import written


def case_lines(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits ``(qid, rank, doc_id, score)`` with their document and a summary line.

    A hit whose document is unknown keeps its place. The documents are cut to
    those hit first, so that their texts stay where they are.
    """
    hits = written(hits, "hits")
    known = docs.select("doc_id", "category", "source", F.col("text").alias("passage"))
    wanted = join_hot(known, hits.select("doc_id").distinct(), "doc_id", "doc_id", "left_semi")
    found = hits.join(wanted, "doc_id", "left")
    line = text.case_line(
        F.col("rank"), F.col("score"), F.col("doc_id").cast("string"), F.col("category"), F.col("source")
    )
    return found.select(
        "qid", "rank", "doc_id", "score",
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("source", F.lit("N/A")).alias("source"),
        line.alias("line"),
        F.coalesce("passage", F.lit("")).alias("passage"),
    )


@dataclass(frozen=True)
class TriageEngine:
    """A fitted classifier and an index over the cases ``(doc_id, text, category, source)``.

    The classifier is the aggregate naive Bayes, or any fitted ``pyspark.ml`` model over the
    pipeline's vectors.
    """

    cases: DataFrame
    pipeline: TextPipeline
    classifier: NaiveBayesModel | Model
    index: Bm25Index

    @classmethod
    def fit(cls, cases: DataFrame, estimator: Estimator | None = None) -> TriageEngine:
        """Train on all cases by their category, index their (clean) text.

        ``estimator`` is one of :func:`casegrain.operators.classify.classifiers` or another of its
        kind; without one naive Bayes is fitted by aggregation.
        """
        pipeline = TextPipeline("text", "category", clean=False)
        vectors = pipeline.fit_vectors(cases, ["doc_id", "category"])
        if estimator is None:
            classifier = fit_naive_bayes(vectors, "category", pipeline.tfidf.size(), pipeline.codes)
        else:
            rows = ml_vectors(vectors, pipeline.tfidf.size()).withColumn(
                "y", pipeline.codes.encode(F.col("category")).cast("double"))
            classifier = estimator.fit(balanced(rows))
        return cls(cases, pipeline, classifier, bm25_index(cases.select("doc_id", "text")))

    def save(self, path: str) -> None:
        """All four parts under one folder; what is saved again replaces what was there."""
        self.cases.write.mode("overwrite").parquet(f"{path}/cases")
        self.pipeline.save(f"{path}/pipeline")
        learned = not isinstance(self.classifier, NaiveBayesModel)
        if learned:
            save_model(self.classifier, f"{path}/model")
        else:
            self.classifier.save(f"{path}/classifier")
        kind = self.cases.sparkSession.createDataFrame([(learned,)], "learned boolean")
        kind.write.mode("overwrite").json(f"{path}/kind")
        self.index.save(f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TriageEngine:
        learned = spark.read.schema("learned boolean").json(f"{path}/kind").first()["learned"]
        classifier = load_model(f"{path}/model") if learned else NaiveBayesModel.load(spark, f"{path}/classifier")
        return cls(
            spark.read.parquet(f"{path}/cases"), TextPipeline.load(spark, f"{path}/pipeline"), classifier,
            Bm25Index.load(spark, f"{path}/index"),
        )

    def classify(self, narratives: DataFrame) -> DataFrame:
        """``(qid, prediction, confidence)`` of ``(qid, cleaned_text)``."""
        rows = narratives.select("qid", F.col("cleaned_text").alias("text"))
        if not isinstance(self.classifier, NaiveBayesModel):
            predicted = predict(self.classifier, self.pipeline.transform(rows, ["qid"]), self.pipeline.codes)
            return predicted.select("qid", F.col("predicted").alias("prediction"), "confidence")
        return predict_naive_bayes(
            self.pipeline.vectors(rows, ["qid"]), self.classifier, self.pipeline.tfidf
        )

    def search(
        self, narratives: DataFrame, k: int, dense: DataFrame | None = None, method: str | None = None
    ) -> DataFrame:
        """Similar cases: ``sparse`` (BM25), ``dense`` (the ranking given) or ``hybrid`` (both fused).

        Hybrid when a dense ranking is given, else sparse, unless told otherwise.
        """
        method = method or ("sparse" if dense is None else "hybrid")
        if method not in ("sparse", "dense", "hybrid"):
            raise ValueError(f"no such method: {method}")
        if method != "sparse" and dense is None:
            raise ValueError(f"{method} search needs a dense ranking")
        if method == "dense":
            return dense.where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")
        asked = narratives.select("qid", F.col("cleaned_text").alias("text"))
        if method == "sparse":
            return bm25_search(asked, self.index, k)
        return fuse(bm25_search(asked, self.index, 50), dense, k)

    def triage(
        self, narratives: DataFrame, k: int = 3, dense: DataFrame | None = None, method: str | None = None
    ) -> DataFrame:
        """A row per similar case of each narrative ``(qid, text)``.

        A narrative without any similar case keeps one row.
        """
        cleaned = computed_once(narratives, "cleaned_text", text.clean(F.col("text")))
        predicted = self.classify(cleaned)
        lines = case_lines(self.search(cleaned, k, dense, method), self.cases)
        return predicted.join(lines, "qid", "left")
