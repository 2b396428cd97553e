"""TF-IDF features as tables, label codes, class weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain import fixed_values as fixed
from casegrain.functions import text
from casegrain.operators.ranking import first_per_group
from casegrain.operators.terms import exploded, found_in_words, with_term_counts
from casegrain.operators.vocabulary import frequent_terms
from casegrain.workspace import fresh_path, written


def word_table(
    df: DataFrame, text_column: str, keep: Sequence[str],
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> DataFrame:
    """``keep`` columns plus ``words``: the content words of each row, in order.

    A column ``tokens`` saves the work of finding them in the text again.
    """
    if "tokens" in df.columns:
        return df.select(*keep, text.content_of(F.col("tokens"), stop_words).alias("words"))
    return df.select(*keep, text.content_words(F.col(text_column), stop_words).alias("words"))


def counted_terms(words: DataFrame) -> DataFrame:
    """Replace ``words`` by ``terms``: counted one- and two-word terms.

    Several times the size of the words: so it is the words that get written,
    when anything is, and never the terms.
    """
    keys = [c for c in words.columns if c != "words"]
    return with_term_counts(words, F.col("words"), pairs=True).select(*keys, "terms")


def term_table(
    df: DataFrame, text_column: str, keep: Sequence[str],
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> DataFrame:
    return counted_terms(word_table(df, text_column, keep, stop_words))


@dataclass(frozen=True)
class TfidfModel:
    """``vocabulary(term, idx, df, idf)``, at most ``max_features`` rows."""

    vocabulary: DataFrame
    max_features: int = fixed.TFIDF_FEATURES
    sublinear: bool = True
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS)

    def size(self) -> int:
        return self.vocabulary.count()

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark = self.vocabulary.sparkSession
        settings = [(self.max_features, self.sublinear, list(self.stop_words))]
        spark.createDataFrame(
            settings, "max_features int, sublinear boolean, stop_words array<string>"
        ).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        settings = spark.read.schema(
            "max_features int, sublinear boolean, stop_words array<string>"
        ).json(f"{path}/settings").first()
        return cls(
            spark.read.parquet(f"{path}/vocabulary"), settings.max_features,
            settings.sublinear, tuple(settings.stop_words),
        )


def fit_tfidf(
    words: DataFrame, max_features: int = fixed.TFIDF_FEATURES, min_df: int = fixed.TFIDF_MIN_DF,
    sublinear: bool = True, stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
    keep: bool = True,
) -> TfidfModel:
    """The most frequent terms with smoothed inverse document frequencies.

    ``words`` is a written word table. The cut is by corpus frequency, ties by term; see
    :func:`casegrain.operators.vocabulary.frequent_terms` for what moves.
    """
    n_docs = words.count()
    top = frequent_terms(words, max_features, min_df)
    # The window runs over the bounded vocabulary, not over the corpus.
    vocabulary = top.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        "df",
        (F.ln((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"),
    )
    if keep:
        vocabulary = written(vocabulary, "tfidf-vocabulary")
    return TfidfModel(vocabulary, max_features, sublinear, tuple(stop_words))


def unit_vectors(rows: DataFrame, model: TfidfModel) -> DataFrame:
    """Replace ``words`` (or ``terms``) by ``vector: array<struct<idx, term, weight>>``, L2 = 1.

    A row's terms are looked up where they are, a batch of rows at a time, so
    nothing is shuffled. The vocabulary, at most ``max_features`` rows, travels
    with the task. A row without any of its terms has an empty vector. Words
    and their adjacent pairs are looked up as numbers: terms that are not in
    the vocabulary never become strings.
    """
    given = "words" if "words" in rows.columns else "terms"
    keys = [c for c in rows.columns if c != given]
    vocabulary = model.vocabulary.select("term", "idx", "idf").toArrow().sort_by("idx")
    look_up = found_in_words if given == "words" else _found_in_terms
    return rows.select(*keys, _looked_up(vocabulary, model.sublinear, look_up)(given).alias("vector"))


def _found_in_terms(known: pa.Array):
    """Row, place in the vocabulary and count of each known term of a batch of counted terms."""

    def found(batch: pa.ListArray) -> Iterator[tuple[pa.ListArray, np.ndarray, np.ndarray, np.ndarray]]:
        counted = batch.flatten()
        row = pc.list_parent_indices(batch).to_numpy()
        place = pc.index_in(counted.field("term"), value_set=known)
        hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        idx = place.take(pa.array(hit)).to_numpy().astype(np.int32)
        row, tf = row[hit], counted.field("tf").to_numpy()[hit]
        order = np.lexsort((idx, row))
        yield batch, row[order], idx[order], tf[order]

    return found


def _looked_up(vocabulary: pa.Table, sublinear: bool, look_up):
    known, idf = vocabulary["term"].combine_chunks().cast(pa.string()), vocabulary["idf"].to_numpy()

    @F.arrow_udf("array<struct<idx:int,term:string,weight:double>>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = look_up(known)
        for batch in batches:
            parts = []
            for rows, row, idx, tf in found(batch):
                weight = ((1.0 + np.log(tf)) if sublinear else tf) * idf[idx]
                length = np.sqrt(np.bincount(row, weight * weight, len(rows)))
                entries = pa.StructArray.from_arrays(
                    [pa.array(idx), known.take(pa.array(idx)), pa.array(weight / length[row])],
                    names=["idx", "term", "weight"])
                starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))])
                parts.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), entries))
            yield pa.concat_arrays(parts)

    return vectors


def long_weights(vectors: DataFrame) -> DataFrame:
    """One row per non-zero weight: keys, ``term``, ``idx``, ``weight``."""
    keys = [c for c in vectors.columns if c != "vector"]
    return exploded(vectors, keys, "vector", "_v").select(*keys, "_v.*")


def ml_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """``vector`` as ``features`` for ``pyspark.ml``, written once.

    The table is written in the storage layout of sparse vectors and read back
    as vectors, so no row passes through Python. All estimators share it.
    """
    spark = vectors.sparkSession
    keys = [c for c in vectors.columns if c != "vector"]
    stored = vectors.select(
        *keys,
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(size).alias("size"),
            F.transform("vector", lambda x: x.idx).alias("indices"),
            F.transform("vector", lambda x: x.weight).alias("values"),
        ).alias("features"),
    )
    path = fresh_path(spark, "features")
    # Even files of a good size: iterative fits read this table many times.
    stored.hint("rebalance").write.parquet(path)
    fields = [f for f in vectors.schema.fields if f.name in keys]
    schema = T.StructType(fields + [T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


# --- Labels -------------------------------------------------------------------


class LabelCodes:
    """Labels in sorted order as codes 0 to k-1, and back.

    ``counts`` are the rows per label of the table it was fitted on.
    """

    def __init__(self, labels: Sequence[str], counts: Sequence[int] | None = None):
        self.labels = sorted(labels)
        given = dict(zip(labels, counts)) if counts else {}
        self.counts = [given[x] for x in self.labels] if given else None

    @classmethod
    def fit(cls, df: DataFrame, column: str, at_most: int = 10_000) -> LabelCodes:
        found = df.where(F.col(column).isNotNull()).groupBy(column).count()
        rows = found.limit(at_most + 1).collect()
        if len(rows) > at_most:
            raise ValueError(f"more than {at_most} labels in {column}")
        return cls([row[0] for row in rows], [row[1] for row in rows])

    def encode(self, label: Column) -> Column:
        """The code of a label; one that was not seen is an error when it runs."""
        code = F.array_position(self._array(), label) - 1
        return F.when(code >= 0, code).otherwise(
            F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(label, F.lit("null"))))
        ).cast("bigint")

    def decode(self, code: Column) -> Column:
        return F.get(self._array(), code.cast("int"))

    def _array(self) -> Column:
        return F.array(*[F.lit(x) for x in self.labels])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * n_class)``, one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    classes = counts.agg(F.count(F.lit(1))).scalar()
    rows = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(
        label, "n_class", (rows / (classes * F.col("n_class"))).alias("class_weight")
    )


def class_terms(
    docs: DataFrame, label: str, id_column: str = "complaint_id", text_column: str = "cleaned_text",
    max_features: int = fixed.CLASS_TERM_FEATURES, n: int = fixed.CLASS_TERMS,
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> DataFrame:
    """The terms with the highest mean weight in each class.

    Plain term counts here (not sublinear) and every term from one document on.
    """
    words = written(word_table(docs, text_column, [id_column, label], stop_words), "class-words")
    model = fit_tfidf(words, max_features, min_df=1, sublinear=False, stop_words=stop_words)
    sums = (
        long_weights(unit_vectors(words, model))
        .groupBy(label, "term")
        .agg(F.sum("weight").alias("_sum"))
    )
    sizes = words.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    means = sums.join(sizes, label).select(
        label, "term", F.round(F.col("_sum") / F.col("_size"), 6).alias("mean_weight")
    )
    order = [F.col("mean_weight").desc(), F.col("term")]
    return first_per_group(means, [label], order, n, rank="rank").withColumn(
        "rank", F.col("rank").cast("bigint")
    )
