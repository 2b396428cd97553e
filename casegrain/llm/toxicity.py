"""Toxicity classifier whose score does not change when identity terms are swapped.

A logistic regression over hashed words and word beginnings. Beside the log loss of the
labelled texts it minimises, for texts that mention a group, the squared difference
between the text's score and that of its counterfactual, in which each identity term is
replaced by another of its kind. Weights thus cannot settle on group names alone, and a
neutral mention does not raise a score.

The model is fitted on a bounded number of labelled rows (``most_rows`` per label, those
with the lowest hash); everything else covers all rows. Only features that differ between
the labels (chi-square) get a weight, at most ``most_features`` of them, so the model is
small enough to travel with the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from casegrain.llm.shared import column, remainder, whole_row

#: Identity terms by kind; a swap stays inside its kind. A parameter.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("african", "european", "american", "arab", "chinese", "indian", "mexican"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
THRESHOLD = 0.7
MOST_ROWS = 10_000
MOST_FEATURES = 50_000
LEAST_ROWS_WITH = 3
CHI_SQUARE = 10.83
BEGINNINGS = (4, 5, 6)
KNOWN_WORDS = 300_000
_TOKEN = re.compile(r"[^\W\d_]+")


def swaps(terms: Sequence[Sequence[str]]) -> dict[str, str]:
    """Each term and the next one of its kind."""
    return {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}


def words_of(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def features_of(word: str) -> tuple[int, ...]:
    """32-bit hashes of the word and of its beginnings."""
    parts = [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]
    return tuple(xxh32_intdigest(p.encode()) for p in parts)


class Known(dict):
    """What a word stands for, worked out once; emptied when it has grown too large."""

    def __init__(self, work):
        super().__init__()
        self._work = work

    def __missing__(self, word):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = self._work(word)
        return found


def distinct_features(words: set[str], known: Known) -> np.ndarray:
    return np.unique(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.uint32))


@dataclass
class Rows:
    """Sparse rows: those of row i are ``columns[starts[i]:starts[i + 1]]``, each with value 1."""

    starts: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, lists: Sequence[np.ndarray], chosen: np.ndarray) -> Rows:
        """Feature lists, as places in the sorted array of chosen features."""
        kept = []
        for features in lists:
            at = np.minimum(np.searchsorted(chosen, features), max(0, len(chosen) - 1))
            kept.append(at[chosen[at] == features] if len(chosen) else at[:0])
        starts = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
        return cls(starts, np.concatenate([np.zeros(0, np.int64), *kept]).astype(np.int64))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        summed = np.concatenate([[0.0], np.cumsum(weights[self.columns])])
        return summed[self.starts[1:]] - summed[self.starts[:-1]]

    def transposed_dot(self, by_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(by_row, np.diff(self.starts)), size)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, features) -> float:
        return float(sigmoid(self.bias + sum(self.weights[f] for f in sorted(features))))


def telling_features(lists: Sequence[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """Features in enough rows whose share of rows differs between the labels, sorted."""
    empty = np.zeros(0, np.uint32)
    (toxic, toxic_counts), (clean, clean_counts) = (
        np.unique(np.concatenate([empty, *(x for x, y in zip(lists, labels) if y == label)]), return_counts=True)
        for label in (1, 0)
    )
    all_ = np.union1d(toxic, clean)
    a, counts = np.zeros(len(all_)), np.zeros(len(all_))
    a[np.searchsorted(all_, toxic)] = toxic_counts
    counts[np.searchsorted(all_, clean)] = clean_counts
    counts += a
    n, n1 = len(labels), int(labels.sum())
    expected = counts * (n1 / max(n, 1))
    spread = expected * (1 - counts / max(n, 1)) * (1 - n1 / max(n, 1))
    chi = (a - expected) ** 2 / np.maximum(spread, 1e-9)
    good = np.flatnonzero((counts >= LEAST_ROWS_WITH) & (chi >= CHI_SQUARE))
    return np.sort(all_[good[np.argsort(-chi[good], kind="stable")[:most]]])


def fit(
    lists: Sequence[np.ndarray], labels: np.ndarray, swapped: Sequence[np.ndarray], swapped_of: np.ndarray,
    penalty: float = 2.0, ridge: float = 1e-4, steps: int = 200, most_features: int = MOST_FEATURES,
) -> Model:
    """Minimise mean log loss + penalty * mean (score - swapped score)^2 + ridge * |w|^2 by Adam.

    Both labels weigh the same in the loss, so a rare one is not drowned. Without rows of
    both labels the model is a constant below any threshold.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model({}, -4.0)
    chosen = telling_features(lists, labels, most_features)
    size = len(chosen)
    rows, other = Rows.of(lists, chosen), Rows.of(swapped, chosen)
    original = Rows.of([lists[i] for i in swapped_of], chosen)
    weights, bias = np.zeros(size), 0.0
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        error = balance * (sigmoid(rows.dot(weights) + bias) - labels)
        gradient = rows.transposed_dot(error, size) + 2 * ridge * weights
        if len(swapped_of):
            before = sigmoid(original.dot(weights) + bias)
            after = sigmoid(other.dot(weights) + bias)
            pull = 2 * penalty * (before - after) / len(swapped_of)
            gradient += original.transposed_dot(pull * before * (1 - before), size)
            gradient -= other.transposed_dot(pull * after * (1 - after), size)
        whole = np.append(gradient, error.sum())
        moment = 0.9 * moment + 0.1 * whole
        square = 0.99 * square + 0.01 * whole**2
        change = 0.2 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights -= change[:-1]
        bias -= change[-1]
    return Model(dict(zip(chosen.tolist(), weights.tolist())), float(bias))


def _featured(pairs: dict[str, str]):
    """Labelled rows in; their features and those of the text with identity terms swapped out."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(features_of)
        for batch in batches:
            plain, swapped = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                plain.append(distinct_features(words, known))
                other = {pairs.get(w, w) for w in words}
                swapped.append(distinct_features(other, known) if other != words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *(pa.array([x if x is None else x.view(np.int32) for x in part], pa.list_(pa.int32()))
                   for part in (plain, swapped))],
                names=["doc_id", "toxic", "features", "swapped"])

    return featured


def training_ids(labels: DataFrame, most_rows: int) -> DataFrame:
    """``doc_id, toxic`` to learn from: of each label the rows with the lowest hash, never held-out ones.

    Several labels of one id count as toxic if one of them is; null labels are left out.
    """
    usable = (
        labels.select(column("doc_id").cast("long").alias("doc_id"), column("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .where(remainder(F.col("doc_id"), 3) != 1)
    )
    one, other = (
        usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
        for value in (0, 1)
    )
    return one.unionByName(other)


def train(
    docs: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", **options,
) -> Model:
    """Fit the model on the labelled rows of ``docs`` that :func:`training_ids` chooses.

    At most ``2 * most_rows`` ids are broadcast and as many rows of hashes come to the driver:
    of documents that share an id the one with the smallest text.
    """
    ids = training_ids(labels, most_rows)
    rows = (
        docs.select(column(id_col).cast("long").alias("doc_id"),
                    F.coalesce(column(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id").groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
        .mapInArrow(_featured(swaps(terms)), "doc_id long, toxic int, features array<int>, swapped array<int>")
    )
    table = rows.toArrow()
    order = np.lexsort((table["toxic"].to_numpy(), table["doc_id"].to_numpy()))
    # Views into the one buffer of each chunk, not copies of their rows.
    lists = [np.asarray(x.values).view(np.uint32) for x in table["features"]]
    others = [np.asarray(x.values).view(np.uint32) if x.is_valid else None for x in table["swapped"]]
    lists, others = [lists[i] for i in order], [others[i] for i in order]
    swapped = [(i, x) for i, x in enumerate(others) if x is not None]
    return fit(
        lists, table["toxic"].to_numpy()[order].astype(np.int64), [x for _, x in swapped],
        np.array([i for i, _ in swapped], np.int64), **options,
    )


def score(model: Model, text: Column) -> Column:
    """The model's score in [0, 1] of each text; an empty one gets the score of no features."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(lambda word: tuple(f for f in features_of(word) if f in model.weights))
        for batch in batches:
            yield pa.array(
                [model.score(set(chain.from_iterable(map(known.__getitem__, words_of(t)))))
                 for t in batch.to_pylist()], pa.float64())

    return scored(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; null is the empty text; equal texts score alike.

    An empty table gives no rows.
    """
    doc_id = column(id_col).cast("long")
    return docs.select(
        doc_id.alias("doc_id"), (remainder(doc_id, 3) == 1).alias("held_out"),
        score(model, column(text_col)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns, whatever their names.

    Null is the empty text; repeated rows stay or go together; an empty table stays empty.
    """
    rows = docs.select(whole_row(docs).alias("row"), score(model, column(text_col)).alias("score"))
    return rows.where(F.col("score") < threshold).select("row.*")
