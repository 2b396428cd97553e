"""Classifiers over TF-IDF features: fit, predict, compare, keep."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.functions import text
from casegrain.operators import metrics
from casegrain.operators.features import (
    LabelCodes,
    TfidfModel,
    class_weights,
    fit_tfidf,
    ml_vectors,
    unit_vectors,
    word_table,
)
from casegrain.operators.forest import SparseForest
from casegrain.operators.squared_hinge import SquaredHingeSVC
from casegrain.workspace import written


TOLERANCE = 1e-4
_SETTINGS = "text_column string, label string, min_df int, clean boolean, labels array<string>"


class TextPipeline:
    """Cleaning, TF-IDF and label codes, fitted on training rows only."""

    def __init__(
        self, text_column: str = "cleaned_text", label: str = "primary_category",
        max_features: int = fixed.TFIDF_FEATURES, min_df: int = fixed.TFIDF_MIN_DF,
        stop_words=tuple(fixed.STOP_WORDS), clean: bool = True,
    ):
        """``clean=False`` takes the texts as they are, for ones that are clean already."""
        self.text_column, self.label, self.clean = text_column, label, clean
        self.max_features, self.min_df, self.stop_words = max_features, min_df, stop_words
        self.tfidf: TfidfModel | None = None
        self.codes: LabelCodes | None = None

    def _words(self, df: DataFrame, keep: list[str]) -> DataFrame:
        raw = F.col(self.text_column)
        cleaned = df.withColumn("_clean", text.clean(raw) if self.clean else raw)
        return word_table(cleaned, "_clean", keep, self.stop_words)

    def fit(self, train: DataFrame) -> TextPipeline:
        return self._fit(train, written(self._words(train, []), "pipeline-words"))

    def _fit(self, train: DataFrame, words: DataFrame) -> TextPipeline:
        self.tfidf = fit_tfidf(
            words, self.max_features, self.min_df, stop_words=self.stop_words
        )
        self.codes = LabelCodes.fit(train, self.label)
        return self

    def fit_vectors(self, train: DataFrame, keep: list[str]) -> DataFrame:
        """Fit, and the vectors of the same rows; their texts are cut into words once."""
        words = written(self._words(train, keep), "pipeline-words")
        self._fit(train, words)
        return unit_vectors(words, self.tfidf)

    def vectors(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns (a row key) and the sparse ``vector``."""
        if self.tfidf is None:
            raise RuntimeError("the pipeline must be fitted before it transforms")
        return unit_vectors(self._words(df, keep), self.tfidf)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns, ``features`` and, when labelled, the code ``y``."""
        return self._features(self.vectors(df, keep))

    def _features(self, vectors: DataFrame) -> DataFrame:
        rows = ml_vectors(vectors, self.tfidf.size())
        if self.label in vectors.columns:
            rows = rows.withColumn("y", self.codes.encode(F.col(self.label)).cast("double"))
        return rows

    def fit_transform(self, df: DataFrame, keep: list[str], train: Column) -> DataFrame:
        """Fit on the rows where ``train``, over ``keep`` columns, holds; transform all. Texts are cut into words once."""
        words = written(self._words(df, keep), "pipeline-words")
        part = words.where(train)
        self._fit(part, part.select("words"))
        return self._features(unit_vectors(words, self.tfidf))

    def save(self, path: str) -> None:
        if self.tfidf is None:
            raise RuntimeError("the pipeline must be fitted before it is saved")
        self.tfidf.save(f"{path}/tfidf")
        spark = self.tfidf.vocabulary.sparkSession
        settings = [(self.text_column, self.label, self.min_df, self.clean, self.codes.labels)]
        spark.createDataFrame(settings, _SETTINGS).write.mode("overwrite").json(f"{path}/pipeline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextPipeline:
        row = spark.read.schema(_SETTINGS).json(f"{path}/pipeline").first()
        tfidf = TfidfModel.load(spark, f"{path}/tfidf")
        pipeline = cls(
            row.text_column, row.label, tfidf.max_features, row.min_df, tfidf.stop_words, row.clean
        )
        pipeline.tfidf, pipeline.codes = tfidf, LabelCodes(row.labels)
        return pipeline


@dataclass(frozen=True)
class VectorisedSplits:
    train: DataFrame
    val: DataFrame
    test: DataFrame
    pipeline: TextPipeline


def vectorise_splits(
    split: DataFrame, id_column: str = "complaint_id", pipeline: TextPipeline | None = None,
    save_to: str | None = None,
) -> VectorisedSplits:
    """Fit on the training rows, transform all three parts from the same words."""
    pipeline = pipeline or TextPipeline()
    rows = pipeline.fit_transform(split, [id_column, pipeline.label, "split"], F.col("split") == "train")
    if save_to:
        pipeline.save(save_to)
    part = lambda name: rows.where(F.col("split") == name)
    return VectorisedSplits(part("train"), part("val"), part("test"), pipeline)


def classifiers(n_train: int, seed: int = fixed.SEED) -> dict[str, Estimator]:
    """The four baseline classifiers by name.

    Logistic regression is balanced by a ``weight`` column; its penalty is a
    per-row mean here, hence ``1 / (C * n)``. The linear SVM balances itself.
    """
    columns = {"featuresCol": "features", "labelCol": "y"}
    weighted = {**columns, "weightCol": "weight"}
    return {
        "MultinomialNB": NaiveBayes(modelType="multinomial", smoothing=fixed.NB_SMOOTHING, **columns),
        "LogisticRegression": LogisticRegression(
            family="multinomial", regParam=1.0 / (2.0 * n_train), maxIter=1000,
            tol=TOLERANCE, standardization=False, **weighted,
        ),
        "LinearSVC": SquaredHingeSVC(c=1.0, features="features", label="y"),
        "RandomForest": SparseForest(num_trees=150, max_depth=30, seed=seed, features="features", label="y"),
    }


def balanced(train: DataFrame) -> DataFrame:
    """Add ``weight``, ``n / (k * n_class)``, from the code column ``y``."""
    weights = class_weights(train, "y").select("y", F.col("class_weight").alias("weight"))
    return train.join(F.broadcast(weights), "y")  # one row per label code


def predict(model: Model, rows: DataFrame, codes: LabelCodes) -> DataFrame:
    """Add ``predicted`` (a label) and ``confidence`` in percent.

    100 when the model gives no probability.
    """
    out = model.transform(rows)
    confidence = (
        F.array_max(vector_to_array("probability")) * 100
        if "probability" in out.columns
        else F.lit(100.0)
    )
    drop = [c for c in ("rawPrediction", "probability", "features") if c in out.columns]
    return (
        out.withColumn("confidence", confidence)
        .withColumn("predicted", codes.decode(F.col("prediction")))
        .drop("prediction", *drop)
    )


def save_model(model: Model, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def benchmark_classifiers(
    splits: VectorisedSplits, estimators: Mapping[str, Estimator] | None = None,
    id_column: str = "complaint_id",
) -> tuple[DataFrame, dict[str, Model], dict[str, float]]:
    """Fit each classifier and score validation and test rows.

    Gives the result table (best test macro-F1 first), the fitted models and
    the fit times in seconds.
    """
    label, codes = splits.pipeline.label, splits.pipeline.codes
    train = balanced(splits.train)
    if estimators is None:
        estimators = classifiers(splits.train.count())
    models, seconds, predictions = {}, {}, []
    held_out = splits.val.unionByName(splits.test)
    for name, estimator in estimators.items():
        started = time.perf_counter()
        models[name] = estimator.fit(train)
        seconds[name] = time.perf_counter() - started
        predictions.append(
            predict(models[name], held_out, codes)
            .select(F.lit(name).alias("model"), "split", label, "predicted")
        )
    scored = reduce(DataFrame.unionByName, predictions)
    keys = ["model", "split"]
    # Confusion counts are small; everything after them is too.
    cells = written(metrics.confusion(scored, label, "predicted", keys), "confusion")
    means = metrics.summary(metrics.class_report(cells, label, "predicted", keys), keys)
    val = means.where("split = 'val'").select(
        "model", F.col("accuracy").alias("val_accuracy"), F.col("macro_f1").alias("val_macro_f1")
    )
    test = means.where("split = 'test'").select(
        "model", F.col("accuracy").alias("test_accuracy"),
        F.col("macro_precision").alias("test_macro_precision"),
        F.col("macro_recall").alias("test_macro_recall"),
        F.col("macro_f1").alias("test_macro_f1"),
        F.col("weighted_f1").alias("test_weighted_f1"),
    )
    table = val.join(test, "model").orderBy(F.col("test_macro_f1").desc(), "model")
    return table, models, seconds
