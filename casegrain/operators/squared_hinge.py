"""Linear one-vs-rest support vector machine with squared hinge loss, fitted on Spark.

For each class k, with +1 for its rows and -1 for all others, it minimises

    (|w|^2 + b^2) / 2 + C * sum_i s_i * max(0, 1 - t_i * (w x_i + b))^2

where s_i is the class's balanced weight for its own rows and 1 for the others. The
problem is strongly convex with modulus 1, so a gradient of norm g leaves the weights at
most g away from the solution; that is the stopping rule. All classes move at once, each
by its own Newton step, found by conjugate gradients: a pass over the rows gives the loss
and gradient of every class at its own point. Only rows within the margin bend the loss.
Once they are few they are kept by themselves, and it is these that the many products with
the curvature read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 4096
#: A Newton step is found to this part of the gradient, in so many products at most.
ROUGHLY, MOST_PRODUCTS = 0.3, 50
#: Partial sums that meet on the driver at most; more of them are summed in tasks first.
PARTS_ON_DRIVER = 16
#: Arrays as bytes: Spark would copy array columns element by element.
_BLOCK = "rows binary, indices binary, values binary, y binary"
_KINDS = (np.int32, np.int32, np.float64, np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(indices, values, y)`` as blocks of coordinates: row in the block, column, value."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_PER_BLOCK):
            part = batch.slice(at, ROWS_PER_BLOCK)
            sizes = np.array([len(v) for v in part.column(1)], np.int64)
            lists = [np.repeat(np.arange(len(sizes)), sizes), *(
                np.asarray(part.column(i).flatten()) for i in (0, 1)), np.asarray(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(lists, _KINDS)],
                names=["rows", "indices", "values", "y"])


def _first_entries(rows: np.ndarray) -> np.ndarray:
    """Where the rows that have entries begin."""
    return np.flatnonzero(np.diff(rows, prepend=-1))


def _products(block: tuple[np.ndarray, ...], first: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per row its product with ``w``, whose last is the bias."""
    rows, indices, values, y = block
    out = np.full(len(y), w[-1])
    if len(first):
        out[rows[first]] += np.add.reduceat(values * w[indices], first)
    return out


def _columns(block: tuple[np.ndarray, ...], by_row: np.ndarray, width: int) -> np.ndarray:
    """The rows' sum, each times its number; last that of the bias."""
    rows, indices, values, _ = block
    return np.append(np.bincount(indices, values * by_row[rows], width - 1), by_row.sum())


def within_margin(
    block: tuple[np.ndarray, ...], first: np.ndarray, w: np.ndarray, k: int,
) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The rows of the block that class ``k`` has within its margin, and how far."""
    rows, indices, values, y = block
    slack = 1.0 - np.where(y == k, 1.0, -1.0) * _products(block, first, w)
    on = slack > 0
    entries = np.flatnonzero(on[rows])
    place = np.cumsum(on, dtype=np.int32) - 1
    return (place[rows[entries]], indices[entries], values[entries], y[on]), slack[on]


def _costs(y: np.ndarray, k: int, positive: np.ndarray, c: float) -> np.ndarray:
    return c * np.where(y == k, positive[k], 1.0)


def block_pass(block: tuple[np.ndarray, ...], weights: np.ndarray, positive: np.ndarray, c: float) -> np.ndarray:
    """Per class without the penalty: loss, rows within the margin, gradient and the curvature's diagonal."""
    classes, width = weights.shape
    out, first = np.zeros((classes, 2 + 2 * width)), _first_entries(block[0])
    for k, w in enumerate(weights):
        part, slack = within_margin(block, first, w, k)
        cost, sign = _costs(part[3], k, positive, c), np.where(part[3] == k, 1.0, -1.0)
        out[k, 0], out[k, 1] = (cost * slack * slack).sum(), len(slack)
        out[k, 2:2 + width] = _columns(part, -2.0 * cost * sign * slack, width)
        out[k, 2 + width:] = _columns((*part[:2], part[2] * part[2], part[3]), 2.0 * cost, width)
    return out


def curved(part: tuple[np.ndarray, ...], k: int, direction: np.ndarray, positive: np.ndarray, c: float) -> np.ndarray:
    """The curvature of class ``k`` times ``direction``, without the penalty; ``part`` is within its margin."""
    along = _products(part, _first_entries(part[0]), direction)
    return _columns(part, 2.0 * _costs(part[3], k, positive, c) * along, len(direction))


def _arrays(block: Row) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(x, kind) for x, kind in zip(block, _KINDS))


def _total(table: RDD, of_part: Callable, *value) -> np.ndarray:
    """The sum of ``of_part(rows of a part, *value)`` over all parts of the table."""
    shared = table.context.broadcast(value)
    found = table.mapPartitions(lambda part: [of_part(part, *shared.value)])
    few = table.getNumPartitions() <= PARTS_ON_DRIVER
    total = np.sum(found.collect(), axis=0) if few else found.treeReduce(np.add)
    shared.destroy()
    return total


def _losses(blocks: Iterator[tuple], weights: np.ndarray, positive: np.ndarray, c: float) -> np.ndarray:
    total = np.zeros((len(weights), 2 + 2 * weights.shape[1]))
    for block in blocks:
        total += block_pass(block, weights, positive, c)
    return total


def _curvatures(
    parts: Iterator[tuple], which: np.ndarray, directions: np.ndarray, positive: np.ndarray, c: float,
) -> np.ndarray:
    place, total = {k: i for i, k in enumerate(which.tolist())}, np.zeros(directions.shape)
    for k, part in parts:
        if k in place:
            total[place[k]] += curved(part, k, directions[place[k]], positive, c)
    return total


class _Problem:
    """Losses, gradients and curvatures over a table of blocks, ``n`` rows in all."""

    def __init__(self, blocks: RDD, n: int, positive: np.ndarray, c: float):
        self.blocks, self.n, self.positive, self.c = blocks, n, positive, c

    def __call__(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per class loss, gradient, the curvature's diagonal and the number of rows within the margin."""
        total, width = _total(self.blocks, _losses, weights, self.positive, self.c), weights.shape[1]
        loss = total[:, 0] + 0.5 * (weights * weights).sum(axis=1)
        return loss, total[:, 2:2 + width] + weights, total[:, 2 + width:] + 1.0, total[:, 1]

    def directions(self, weights: np.ndarray, gradient: np.ndarray, diagonal: np.ndarray, rows: np.ndarray,
                   tolerance: float, which: np.ndarray) -> np.ndarray:
        """The Newton steps of the classes ``which``, with ``rows`` within the margin of each class."""
        shared = self.blocks.context.broadcast((which, weights))

        def parts(blocks: Iterator[tuple]) -> Iterator[tuple]:
            which, weights = shared.value
            for block in blocks:
                first = _first_entries(block[0])
                for k in which.tolist():
                    yield k, within_margin(block, first, weights[k], k)[0]

        within = self.blocks.mapPartitions(parts)
        if rows[which].sum() <= self.n:
            within.persist(StorageLevel.MEMORY_AND_DISK)

        def product(directions: np.ndarray, going: np.ndarray) -> np.ndarray:
            found, some = np.zeros_like(directions), directions[going]
            found[going] = some + _total(within, _curvatures, which[going], some, self.positive, self.c)
            return found

        found = conjugate_gradients(product, gradient[which], diagonal[which], tolerance)
        within.unpersist()
        shared.destroy()
        return found


def conjugate_gradients(product: Callable, gradient: np.ndarray, diagonal: np.ndarray, tolerance: float) -> np.ndarray:
    """Per row roughly the solution of ``H d = -gradient``; ``product(p, rows)`` gives ``H p`` of these rows."""
    d, r = np.zeros_like(gradient), -gradient
    goal = np.maximum(ROUGHLY * np.linalg.norm(gradient, axis=1), tolerance / 2)
    z = r / diagonal
    p, rz = z, (r * z).sum(axis=1)
    for _ in range(MOST_PRODUCTS):
        going = np.linalg.norm(r, axis=1) > goal
        if not going.any():
            break
        h = product(p, going)
        step = np.where(going, rz / np.where(going, (p * h).sum(axis=1), 1.0), 0.0)[:, None]
        d, r = d + step * p, r - step * h
        z = r / diagonal
        before, rz = rz, (r * z).sum(axis=1)
        p = z + np.where(going, rz / np.where(going, before, 1.0), 0.0)[:, None] * p
    return d


def minimise(problem, weights: np.ndarray, tolerance: float, most_passes: int) -> np.ndarray:
    """Each row of ``weights`` to where the norm of its gradient is at most ``tolerance``."""
    loss, gradient, diagonal, rows = problem(weights)
    size, direction = np.ones(len(weights)), np.zeros_like(weights)
    open_ = np.linalg.norm(gradient, axis=1) > tolerance
    turning = open_.copy()
    for _ in range(most_passes):
        if not open_.any():
            return weights
        which = np.flatnonzero(turning)
        if len(which):
            direction[which] = problem.directions(weights, gradient, diagonal, rows, tolerance, which)
            size[which] = 1.0
        trial = weights + (size * open_)[:, None] * direction
        trial_loss, trial_gradient, trial_diagonal, trial_rows = problem(trial)
        turning = np.zeros(len(weights), bool)
        for k in np.flatnonzero(open_):
            slope = gradient[k] @ direction[k]
            if trial_loss[k] > loss[k] + 1e-4 * size[k] * slope + 1e-12 * abs(loss[k]):
                # Too far: to the lowest point of the parabola through what is known.
                rise = trial_loss[k] - loss[k] - size[k] * slope
                size[k] *= np.clip(-slope * size[k] / (2 * rise), 0.1, 0.5)
                continue
            weights[k], loss[k], gradient[k] = trial[k], trial_loss[k], trial_gradient[k]
            diagonal[k], rows[k] = trial_diagonal[k], trial_rows[k]
            turning[k] = open_[k] = np.linalg.norm(gradient[k]) > tolerance
    raise RuntimeError(f"no solution within {most_passes} passes; raise the limit or the tolerance")


class SquaredHingeSVC(Estimator):
    """Balanced one-vs-rest linear machine over ``features`` and the class codes ``y`` (0, 1, ...)."""

    def __init__(self, c: float = 1.0, tolerance: float = 5e-4, most_passes: int = 500,
                 features: str = "features", label: str = "y"):
        super().__init__()
        self.c, self.tolerance, self.most_passes = c, tolerance, most_passes
        self.features, self.label = features, label

    def _fit(self, dataset: DataFrame) -> SquaredHingeModel:
        vector = F.unwrap_udt(self.features)
        rows = dataset.select(vector.alias("v"), F.col(self.label).cast("int").alias("y"))
        dense = F.sequence(F.lit(0), F.size("v.values") - 1)
        indices = F.when(F.size("v.values") > 0, F.coalesce("v.indices", dense)).otherwise(F.array().cast("array<int>"))
        counted = rows.groupBy("y").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.coalesce("v.size", F.size("v.values"))).alias("size")).collect()
        if not counted:
            raise ValueError("no rows to learn from")
        n, classes = sum(r["n"] for r in counted), max(r["y"] for r in counted) + 1
        positive = np.ones(classes)
        for r in counted:
            positive[r["y"]] = n / (len(counted) * r["n"])
        parts = rows.select(indices.alias("indices"), F.col("v.values").alias("values"), "y").mapInArrow(_blocks, _BLOCK)
        blocks = parts.rdd.map(_arrays).persist(StorageLevel.MEMORY_AND_DISK)
        start = np.zeros((classes, max(r["size"] for r in counted) + 1))
        weights = minimise(_Problem(blocks, n, positive, self.c), start, self.tolerance, self.most_passes)
        blocks.unpersist()
        return SquaredHingeModel(weights, self.features)


class SquaredHingeModel(Model, MLWritable, MLReadable):
    """One row of ``weights`` per class, the bias last; ``prediction`` is the class of the largest decision value."""

    def __init__(self, weights: np.ndarray | None = None, features: str = "features"):
        super().__init__()
        self.weights, self.features = weights, features

    def decisions(self, dataset: DataFrame, out: str = "decisions") -> DataFrame:
        """Add the decision values of all classes."""
        weights = self.weights

        @F.arrow_udf("array<double>")
        def decided(vectors: pa.Array) -> pa.Array:
            values = vectors.field("values")
            sizes = np.array([len(v) for v in values], np.int64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            flat = np.asarray(values.flatten())
            given = vectors.field("indices")
            columns = np.concatenate([np.zeros(0, np.int64), *(
                np.asarray(i.values) if i.is_valid else np.arange(n) for i, n in zip(given, sizes))]).astype(np.int64)
            found = np.stack([np.bincount(rows, flat * w[columns], len(sizes)) + w[-1] for w in weights], axis=1)
            return pa.array(list(found), pa.list_(pa.float64()))

        return dataset.withColumn(out, decided(F.unwrap_udt(self.features)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        decided = self.decisions(dataset, "rawPrediction")
        best = F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1
        return decided.withColumn("prediction", best.cast("double"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: SquaredHingeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"features": self.model.features})
        rows = [(k, w.tolist()) for k, w in enumerate(self.model.weights)]
        self.sparkSession.createDataFrame(rows, "k int, weights array<double>").write.parquet(f"{path}/weights")


class _Reader(MLReader):
    def load(self, path: str) -> SquaredHingeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/weights").orderBy("k").collect()  # one per class
        model = SquaredHingeModel(np.array([r["weights"] for r in rows]), metadata["features"])
        model._resetUid(metadata["uid"])
        return model
