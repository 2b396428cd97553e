"""Multinomial naive Bayes over term weights, as plain aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.operators.features import LabelCodes, TfidfModel, long_weights
from casegrain.workspace import written

MODEL_CELLS = 20_000_000
_SETTINGS = "floor array<double>, prior array<double>, labels array<string>"


@dataclass(frozen=True)
class NaiveBayesModel:
    """``terms(idx, delta)`` and, per class in label order, a floor and a prior.

    ``delta[c]`` is how much more likely the term is in class ``c`` than a term
    the class has never shown, whose log-likelihood is ``floor[c]``.
    """

    terms: DataFrame
    floor: list[float]
    prior: list[float]
    codes: LabelCodes

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        rows = [(self.floor, self.prior, self.codes.labels)]
        self.terms.sparkSession.createDataFrame(rows, _SETTINGS).write.mode("overwrite").parquet(
            f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NaiveBayesModel:
        row = spark.read.parquet(f"{path}/classes").first()
        return cls(spark.read.parquet(f"{path}/terms"), row.floor, row.prior, LabelCodes(row.labels))

    def broadcastable(self, n_terms: int) -> bool:
        return n_terms * len(self.prior) <= MODEL_CELLS


def fit_naive_bayes(
    vectors: DataFrame, label: str, n_terms: int, codes: LabelCodes | None = None,
    smoothing: float = fixed.NB_SMOOTHING,
) -> NaiveBayesModel:
    """Class priors and smoothed term likelihoods from ``(label, vector)`` rows.

    Weights are summed per (term, class) in the map tasks first. Only per-class
    totals (one row) come to the driver. ``codes`` are fitted on the same rows.
    """
    codes = codes or LabelCodes.fit(vectors, label)
    in_class = lambda value, c: F.sum(F.when(F.col(label) == c, value).otherwise(0.0))
    weights = long_weights(vectors.select(label, "vector"))
    per_term = weights.groupBy("idx").agg(
        F.array(*[in_class(F.col("weight"), c) for c in codes.labels]).alias("mass")
    )
    per_term = written(per_term, "naive-bayes")
    mass = lambda i: F.sum(F.get("mass", F.lit(i)))
    totals = per_term.agg(*[mass(i).alias(f"m{i}") for i in range(len(codes.labels))]).first()
    counts = codes.counts or LabelCodes.fit(vectors, label).counts
    n = sum(counts)
    floor = [math.log(smoothing) - math.log((m or 0.0) + smoothing * n_terms) for m in totals]
    prior = [math.log(c / n) for c in counts]
    delta = F.transform("mass", lambda m: F.ln(m + smoothing) - math.log(smoothing))
    return NaiveBayesModel(per_term.select("idx", delta.alias("delta")), floor, prior, codes)


def predict_naive_bayes(
    vectors: DataFrame, model: NaiveBayesModel, tfidf: TfidfModel
) -> DataFrame:
    """Add ``prediction`` and ``confidence`` (percent); drops the vector.

    The other columns must be a row key. The model has at most one row per
    vocabulary term; it is broadcast when its cells are within a bound.
    """
    keys = [c for c in vectors.columns if c != "vector"]
    k = len(model.prior)
    entries = vectors.select(*keys, F.explode_outer("vector").alias("_v")).select(
        *keys, F.col("_v.idx").alias("idx"), F.col("_v.weight").alias("weight")
    )
    terms = model.terms
    if model.broadcastable(tfidf.max_features):
        terms = F.broadcast(terms)
    likelihood = lambda i: (
        F.coalesce(F.col("weight"), F.lit(0.0))
        * (F.lit(model.floor[i]) + F.coalesce(F.get("delta", F.lit(i)), F.lit(0.0)))
    )
    summed = entries.join(terms, "idx", "left").groupBy(*keys).agg(
        F.array(*[F.sum(likelihood(i)) + model.prior[i] for i in range(k)]).alias("_log")
    )
    return (
        summed.withColumn("_best", F.array_max("_log"))
        .select(
            *keys,
            model.codes.decode(F.array_position("_log", F.col("_best")) - 1).alias("prediction"),
            (
                100.0
                / F.aggregate(
                    "_log", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_best"))
                )
            ).alias("confidence"),
        )
    )
