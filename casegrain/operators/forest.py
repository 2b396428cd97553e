"""Random forest over sparse rows, grown level by level on Spark.

All trees grow at once. A row is kept as the bins of its values that are not zero; a node
looks at the square root of all columns, so of a row's few such values it meets one or two.
Only those are counted, per node, column, bin and class: what a node's rows hold besides is
zero, and follows from the node's total. A pass over the rows moves each to its child in
every tree and counts for the new nodes; after some levels the moved rows are written; a shuffle brings the counts of a node together,
where its split is chosen. The driver holds the trees and the columns drawn for a level.

As in ``pyspark.ml``: a row's weight in a tree is drawn from Poisson(1), columns are drawn
per node, thresholds come from some 10,000 rows, the Gini impurity decides, and a forest's
probability is the mean of its leaves' class shares; a split into two leaves that predict
the same class is taken back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.workspace import fresh_path, remove, written

ROWS_PER_BLOCK = 8192
ROWS_PER_PARTITION = 16_384
#: Rows that thresholds are taken from, at least.
ROWS_FOR_THRESHOLDS = 10_000
#: What one numpy step looks up, and the bytes of the dense rows it looks them up in, at most.
LOOKED_UP, DENSE_BYTES = 1 << 18, 1 << 21
#: A pass moves the rows anew through at most one in so many of the levels above; then they are written at
#: their nodes. Moving gets cheaper with depth, as trees end, and writing does not.
LEVELS_TO_MOVE = 4
#: Counts a task holds before it sums and sends them.
COUNTS_HELD = 1 << 22
#: Nodes whose drawn columns travel to the tasks at once; a wider level takes several passes.
NODES_PER_PASS = 1 << 17
#: Counts that meet in one group, roughly.
COUNTS_PER_GROUP = 1 << 21
_BLOCK = "starts binary, columns binary, codes binary, y binary, weights binary, nodes binary"
_KINDS = (np.int64, np.int32, np.uint8, np.int32, np.uint8, np.int32)


# --- Bins ---------------------------------------------------------------------


def thresholds_of(values: np.ndarray, rows: int, most_bins: int) -> list[float]:
    """Where to cut a column that has these values, not zero, in some of ``rows`` rows."""
    distinct, counts = np.unique(values, return_counts=True)
    if rows > len(values):
        at = np.searchsorted(distinct, 0.0)
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts, at, rows - len(values))
    middles = (distinct[1:] + distinct[:-1]) / 2
    if len(middles) < most_bins:
        return middles.tolist()
    stride = rows / most_bins
    found, target, reached = [], stride, np.cumsum(counts)
    for i, middle in enumerate(middles):
        if abs(reached[i] - target) < abs(reached[i + 1] - target):
            found.append(float(middle))
            target += stride
    return found


@dataclass(frozen=True)
class Bins:
    """Thresholds of all columns, one after the other; those of column ``f`` end where ``f + 1``'s begin."""

    thresholds: np.ndarray
    starts: np.ndarray

    @property
    def width(self) -> int:
        return len(self.starts) - 1

    def of(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The number of the column's thresholds below the value."""
        low, high = self.starts[columns], self.starts[columns + 1]
        for _ in range(int(np.diff(self.starts).max(initial=0)).bit_length()):
            middle = (low + high) // 2
            open_ = low < high
            above = open_ & (self.thresholds[np.where(open_, middle, 0)] < values)
            low, high = np.where(above, middle + 1, low), np.where(open_ & ~above, middle, high)
        return low - self.starts[columns]

    def of_zero(self) -> np.ndarray:
        if not len(self.thresholds):
            return np.zeros(self.width, np.uint8)
        return self.of(np.arange(self.width), np.zeros(self.width)).astype(np.uint8)

    def codes(self, columns: np.ndarray, values: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Bins plus one; 0 in the bin of zero."""
        if not len(self.thresholds):
            return np.zeros(len(columns), np.uint8)
        found = self.of(columns, values)
        return np.where(found == zero[columns], 0, found + 1).astype(np.uint8)


def _fit_bins(rows: DataFrame, n: int, width: int, most_bins: int, seed: int) -> Bins:
    wanted = max(most_bins * most_bins, ROWS_FOR_THRESHOLDS)
    taken = written(rows.sample(wanted / n, seed) if wanted < n else rows, "forest-sample")
    n_taken, most_bins = taken.count(), min(most_bins, n)
    entries = taken.select(F.explode(F.arrays_zip("indices", "values")).alias("e")).select(
        F.col("e.indices").alias("idx"), F.col("e.values").alias("value")).where("value != 0")

    def cut(table: pa.Table) -> pa.Table:
        columns, values = np.asarray(table["idx"]), np.asarray(table["value"])
        order = np.argsort(columns, kind="stable")
        columns, values = columns[order], values[order]
        found, starts = np.unique(columns, return_index=True)
        cuts = [thresholds_of(part, n_taken, most_bins) for part in np.split(values, starts[1:])]
        return pa.table({"idx": pa.array(found, pa.int32()), "cuts": pa.array(cuts, pa.list_(pa.float64()))})

    found = entries.groupBy((F.col("idx") % 256).alias("part")).applyInArrow(
        cut, "idx int, cuts array<double>").toArrow().sort_by("idx")
    sizes = np.zeros(width, np.int64)
    sizes[np.asarray(found["idx"])] = [len(x) for x in found["cuts"]]
    flat = found["cuts"].combine_chunks().flatten() if found.num_rows else pa.array([], pa.float64())
    return Bins(np.asarray(flat), np.concatenate([[0], np.cumsum(sizes)]))


# --- Blocks of rows -----------------------------------------------------------


def _sparse(vector: Column) -> tuple[Column, Column]:
    """Indices and values of a vector that is stored sparse or dense."""
    v = F.unwrap_udt(vector)
    values, given = v.getField("values"), v.getField("indices")
    dense = F.sequence(F.lit(0), F.size(values) - 1)
    return F.when(F.size(values) > 0, F.coalesce(given, dense)).otherwise(F.array().cast("array<int>")), values


def _row_starts(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array([len(x) for x in lists], np.int64))]).astype(np.int64)


def _to_blocks(bins: Bins, trees: int, seed: int) -> Callable:
    zero = bins.of_zero()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(at, ROWS_PER_BLOCK)
                starts = _row_starts(part.column(0))
                columns, values = (np.asarray(part.column(i).flatten()) for i in (0, 1))
                codes = bins.codes(columns, values, zero)
                kept = codes > 0
                starts = np.concatenate([[0], np.cumsum(kept)])[starts]
                weights = np.minimum(draw.poisson(1.0, (part.num_rows, trees)), 255)
                nodes = np.where(weights > 0, np.arange(trees), -1)
                lists = (starts, columns[kept], codes[kept], np.asarray(part.column(2)), weights, nodes)
                yield _block_row(lists)

    return blocks


def _block_row(lists) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for x, kind in zip(lists, _KINDS)],
        names=["starts", "columns", "codes", "y", "weights", "nodes"])


def _blocks_in(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            lists = [np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in enumerate(_KINDS)]
            yield [*lists[:4], *(x.reshape(-1, trees) for x in lists[4:])]


def _dense(starts: np.ndarray, columns: np.ndarray, codes: np.ndarray, width: int, per_row: int):
    """A few rows at a time, as first row, end and their codes in all columns, flat."""
    n = len(starts) - 1
    step = max(1, min(LOOKED_UP // max(1, per_row), DENSE_BYTES // max(1, width), n))
    flat = np.zeros(step * width, np.uint8)
    for a in range(0, n, step):
        b = min(n, a + step)
        part = slice(starts[a], starts[b])
        place = np.repeat(np.arange(b - a) * width, np.diff(starts[a:b + 1])) + columns[part]
        flat[place] = codes[part]
        yield a, b, flat
        flat[place] = 0


# --- One level ----------------------------------------------------------------


def _drawn(draw: np.random.Generator, n: int, width: int, k: int) -> np.ndarray:
    """``k`` different columns for each of ``n`` nodes."""
    out = np.zeros((n, k), np.uint16 if width <= 1 << 16 else np.int32)
    for a in range(0, n, 4096):
        m = min(4096, n - a)
        tried = draw.integers(0, width, (m, 2 * k + 64))
        order = np.argsort(tried, axis=1, kind="stable")
        ranked = np.take_along_axis(tried, order, axis=1)
        first = np.ones(tried.shape, bool)
        np.put_along_axis(first, order[:, 1:], ranked[:, 1:] != ranked[:, :-1], axis=1)
        taken = first & (np.cumsum(first, axis=1) <= k)
        full = taken.sum(axis=1) == k
        out[a:a + m][full] = tried[full][taken[full]].reshape(-1, k)
        for i in np.flatnonzero(~full):
            out[a + i] = draw.choice(width, k, replace=False)
    return out


def _mover(levels, zero: np.ndarray, width: int, trees: int) -> Callable:
    """Each row from its node to that node's child, or to -1 where the tree ends, through all ``levels``."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, columns, codes, y, weights, nodes in _blocks_in(batches, trees):
            nodes = nodes.copy()
            for a, b, flat in _dense(starts, columns, codes, width, 8 * trees):
                for level in levels:
                    feature, bin_, children = level.value
                    row, tree = np.nonzero(nodes[a:b] >= 0)
                    at = nodes[a:b][row, tree]
                    column = np.maximum(feature[at], 0)
                    code = flat[row * width + column].astype(np.int64)
                    right = np.where(code == 0, zero[column], code - 1) > bin_[at]
                    nodes[a + row, tree] = children[at, right.astype(np.int64)]
            yield _block_row((starts, columns, codes, y, weights, nodes))

    return moved if levels else lambda batches: batches


def _planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, all lowest ones first: they compress well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(x: pa.Scalar, kind: type) -> np.ndarray:
    flat = np.frombuffer(x.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def _counter(drawn, first: int, bins: int, classes: int, groups: int, width: int, trees: int) -> Callable:
    """Weights per node, drawn column, bin and class, for nodes from ``first`` on, by group of nodes."""

    def parts(held: list[np.ndarray], m: int, k: int) -> Iterator[pa.RecordBatch]:
        packed = np.sort(np.concatenate(held))
        key = packed >> 8
        at = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(packed & 255, at)
        key = key[at]
        bounds = np.searchsorted(key, -(-np.arange(groups + 1) * m // groups) * (k * bins * classes))
        for g in range(groups):
            part = slice(bounds[g], bounds[g + 1])
            if part.start < part.stop:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], pa.int32()), pa.array([_planes(np.diff(key[part], prepend=0))], pa.binary()),
                     pa.array([_planes(sums[part])], pa.binary())], names=["part", "keys", "sums"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns_of = drawn.value
        m, k = columns_of.shape
        held, size = [], 0
        for starts, columns, codes, y, weights, nodes in _blocks_in(batches, trees):
            for a, b, flat in _dense(starts, columns, codes, width, trees * k):
                here = nodes[a:b] - first
                row, tree = np.nonzero((here >= 0) & (here < m))
                at = here[row, tree].astype(np.int64)
                found = flat.take(np.add(columns_of[at], (row * width)[:, None], dtype=np.int64)).ravel()
                hit = np.flatnonzero(found != 0)
                event = hit // k
                key = (at[event] * k + hit % k) * bins + (found[hit].astype(np.int64) - 1)
                key = key * classes + y[a + row[event]]
                held.append(key << 8 | weights[a + row[event], tree[event]])
                size += len(hit)
                if size >= COUNTS_HELD:
                    yield from parts(held, m, k)
                    held, size = [], 0
        if size:
            yield from parts(held, m, k)

    return counted


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def _impurity(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 1.0 - np.square(counts / np.maximum(n, 1)[:, None]).sum(axis=1)


def best_splits(
    key: np.ndarray, weight: np.ndarray, totals: np.ndarray, drawn: np.ndarray, bins: int, zero: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node, column, last bin to the left and class weights to the left of each node that can gain.

    ``key`` is ``((node * k + place) * bins + bin) * classes + class`` with the column's place among
    the ``k`` drawn; only bins other than zero's are given, the rest of ``totals`` is zero's.
    """
    classes, k = totals.shape[1], drawn.shape[1]
    cell, label = key // classes, key % classes
    cell, which = np.unique(cell, return_inverse=True)
    counts = np.bincount(which * classes + label, weight, len(cell) * classes).reshape(-1, classes)
    # The bin of zero gets what its node has besides.
    begin = _starts(cell // bins)
    pair = (cell // bins)[begin]
    rest = totals[pair // k] - np.add.reduceat(counts, begin, axis=0)
    some = rest.sum(axis=1) > 0
    zero_cell = pair * bins + zero[drawn[pair // k, pair % k]]
    cell, counts = np.concatenate([cell, zero_cell[some]]), np.concatenate([counts, rest[some]])
    order = np.argsort(cell, kind="stable")
    cell, counts = cell[order], counts[order]
    # To the left: all of the same column up to this bin.
    begin = _starts(cell // bins)
    running = np.cumsum(counts, axis=0)
    before = np.where((begin > 0)[:, None], running[begin - 1], 0.0)
    left = running - np.repeat(before, np.diff(np.append(begin, len(cell))), axis=0)
    node = cell // (bins * k)
    total = totals[node]
    right = total - left
    n, n_left, n_right = total.sum(axis=1), left.sum(axis=1), right.sum(axis=1)
    gain = _impurity(total, n) - n_left / n * _impurity(left, n_left) - n_right / n * _impurity(right, n_right)
    gain[n_right <= 0] = 0.0
    begin = _starts(node)
    most = np.maximum.reduceat(gain, begin)
    best = np.flatnonzero((gain > 0) & (gain == np.repeat(most, np.diff(np.append(begin, len(node))))))
    best = best[_starts(node[best])] if len(best) else best
    return node[best], drawn[node[best], cell[best] // bins % k], cell[best] % bins, left[best]


_SPLITS = "node binary, feature binary, bin binary, counts binary"


def _chooser(drawn, totals, bins: int, zero: np.ndarray) -> Callable:
    def chosen(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key = np.concatenate([np.cumsum(_from_planes(x, np.int64)) for x in table["keys"]])
        weight = np.concatenate([_from_planes(x, np.int64) for x in table["sums"]])
        node, feature, bin_, left = best_splits(key, weight, totals.value, drawn.value, bins, zero)
        lists = (node.astype(np.int64), feature.astype(np.int64), bin_.astype(np.int64), left.astype(np.float64))
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in lists], ["node", "feature", "bin", "counts"])

    return chosen


# --- The forest ---------------------------------------------------------------


def pruned(
    feature: np.ndarray, bin_: np.ndarray, left: np.ndarray, counts: np.ndarray, ends: np.ndarray,
) -> tuple[np.ndarray, ...]:
    """The trees without splits into two leaves of one prediction, from the last of the levels upwards.

    Level ``i`` ends at ``ends[i]``; the children of a level are the next one, by pairs.
    """
    feature, says = feature.copy(), counts.argmax(axis=1)
    for begin, end in zip([0, *ends[:-1]][::-1], ends[::-1]):
        at = begin + np.flatnonzero(feature[begin:end] >= 0)
        a, b = left[at], left[at] + 1
        feature[at[(feature[a] < 0) & (feature[b] < 0) & (says[a] == says[b])]] = -1
    kept = np.arange(len(feature)) < ends[0]
    for begin, end in zip([0, *ends[:-1]], ends):
        inner = begin + np.flatnonzero(kept[begin:end] & (feature[begin:end] >= 0))
        kept[left[inner]] = kept[left[inner] + 1] = True
    place = np.cumsum(kept) - 1
    return feature[kept], bin_[kept], place[left[kept]], counts[kept]


class SparseForest(Estimator):
    """Random forest over ``features`` and the class codes ``y`` (0, 1, ...)."""

    def __init__(self, num_trees: int = 20, max_depth: int = 5, max_bins: int = 32, seed: int = 0,
                 features: str = "features", label: str = "y"):
        super().__init__()
        if not 2 <= max_bins <= 255:
            raise ValueError("max_bins must be from 2 to 255")
        self.num_trees, self.max_depth, self.max_bins, self.seed = num_trees, max_depth, max_bins, seed
        self.features, self.label = features, label

    def setNumTrees(self, value: int) -> SparseForest:
        self.num_trees = value
        return self

    def setMaxDepth(self, value: int) -> SparseForest:
        self.max_depth = value
        return self

    def _fit(self, dataset: DataFrame) -> SparseForestModel:
        v = F.unwrap_udt(self.features)
        indices, values = _sparse(F.col(self.features))
        rows = dataset.select(
            indices.alias("indices"), values.alias("values"), F.col(self.label).cast("int").alias("y"))
        n, classes, width = dataset.select(
            F.count(F.lit(1)), F.max(F.col(self.label).cast("int")) + 1,
            F.max(F.coalesce(v.getField("size"), F.size(v.getField("values"))))).first()
        if not n:
            raise ValueError("no rows to learn from")
        bins = _fit_bins(rows, n, width, self.max_bins, self.seed)
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_PARTITION))
        blocks = rows.repartition(parts).mapInArrow(_to_blocks(bins, self.num_trees, self.seed), _BLOCK)
        return SparseForestModel(*self._grown(blocks, bins, classes), bins, self.features)

    def _roots(self, blocks: DataFrame, classes: int) -> np.ndarray:
        trees = self.num_trees

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((trees, classes))
            for _, _, _, y, weights, _ in _blocks_in(batches, trees):
                for c in range(classes):
                    total[:, c] += weights[y == c].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        found = blocks.mapInArrow(summed, "total binary").toArrow()["total"]
        return np.sum([np.frombuffer(x.as_buffer()) for x in found], axis=0).reshape(trees, classes)

    def _grown(self, blocks: DataFrame, bins: Bins, classes: int) -> tuple[np.ndarray, ...]:
        """Per node its column (-1 in a leaf), last bin to the left, left child (the right one follows), weights."""
        spark, zero, width = blocks.sparkSession, bins.of_zero(), bins.width
        context = spark.sparkContext
        draw = np.random.default_rng([self.seed, 1])

        def stored(table: DataFrame) -> tuple[DataFrame, str]:
            path = fresh_path(spark, "forest-rows")
            table.write.parquet(path)
            return spark.read.schema(table.schema).parquet(path), path

        blocks, where = stored(blocks)
        passed = []  # levels since the rows were written
        counts = [self._roots(blocks, classes)]
        new = lambda n: (np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))
        nodes, made = [new(self.num_trees)], self.num_trees
        # Nodes to split, by their place in the level; all roots are there, as rows start from their tree's.
        open_ = np.arange(self.num_trees)
        for depth in range(self.max_depth):
            totals = counts[-1][open_]
            if not width or not len(open_) or not (np.count_nonzero(totals, axis=1) > 1).any():
                break
            node, feature, bin_, left = self._splits(
                blocks, _mover(passed, zero, width, self.num_trees), totals, bins, zero, draw)
            if not len(node):
                break
            below = np.stack([left, totals[node] - left], axis=1).reshape(-1, classes)
            grows = (np.count_nonzero(below, axis=1) > 1) & (depth + 1 < self.max_depth)
            for values, level in zip((feature, bin_, made + 2 * np.arange(len(node))), nodes[-1]):
                level[open_[node]] = values
            made += len(below)
            level = (np.full(len(open_), -1, np.int64), np.zeros(len(open_), np.int64),
                     np.full((len(open_), 2), -1, np.int32))
            level[0][node], level[1][node] = feature, bin_
            level[2][node] = np.where(grows, np.cumsum(grows) - 1, -1).reshape(-1, 2)
            nodes.append(new(len(below)))
            counts.append(below)
            open_ = np.flatnonzero(grows)
            if len(open_):
                passed = [*passed, context.broadcast(level)]
            if len(open_) and LEVELS_TO_MOVE * len(passed) > depth:
                moved, path = stored(blocks.mapInArrow(_mover(passed, zero, width, self.num_trees), _BLOCK))
                remove(spark, where)
                blocks, where = moved, path
                for level in passed:
                    level.destroy()
                passed = []
        for level in passed:
            level.destroy()
        remove(spark, where)
        ends = np.cumsum([len(x) for x in counts])
        return pruned(*(np.concatenate([level[i] for level in nodes]) for i in range(3)), np.concatenate(counts), ends)

    def _splits(self, blocks: DataFrame, moved: Callable, totals: np.ndarray, bins: Bins, zero: np.ndarray,
                draw) -> list[np.ndarray]:
        """The best splits of a level's nodes, in their order; ``moved`` brings the rows to that level."""
        context, classes = blocks.sparkSession.sparkContext, totals.shape[1]
        k = int(np.ceil(np.sqrt(bins.width))) if self.num_trees > 1 else bins.width
        found = []
        for first in range(0, len(totals), NODES_PER_PASS):
            part = totals[first:first + NODES_PER_PASS]
            drawn, shared = context.broadcast(_drawn(draw, len(part), bins.width, k)), context.broadcast(part)
            groups = int(min(len(part), max(context.defaultParallelism, 2 * part.sum() // COUNTS_PER_GROUP)))
            counter = _counter(drawn, first, self.max_bins, classes, groups, bins.width, self.num_trees)
            here = lambda batches, counter=counter: counter(moved(batches))
            table = blocks.mapInArrow(here, "part int, keys binary, sums binary").groupBy("part").applyInArrow(
                _chooser(drawn, shared, self.max_bins, zero), _SPLITS).toArrow()
            drawn.destroy()
            shared.destroy()
            for row in zip(*table.columns):
                node, feature, bin_ = (np.frombuffer(x.as_buffer(), np.int64) for x in row[:3])
                found.append((node + first, feature, bin_, np.frombuffer(row[3].as_buffer()).reshape(-1, classes)))
        if not found:
            return [np.zeros(0, np.int64)] * 4
        node, feature, bin_, left = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(node)
        return [node[order], feature[order], bin_[order], left[order]]


class SparseForestModel(Model, MLWritable, MLReadable):
    """Trees as arrays over all nodes, the roots first; ``probability`` is the mean of the leaves' class shares."""

    def __init__(self, feature: np.ndarray, bin_: np.ndarray, left: np.ndarray, counts: np.ndarray, bins: Bins,
                 features: str = "features"):
        super().__init__()
        self.feature, self.bin, self.left, self.counts, self.bins = feature, bin_, left, counts, bins
        self.features = features
        # Every node but a root is someone's child.
        self.trees = len(feature) - 2 * int((feature >= 0).sum())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, trees, bins, zero = dataset.sparkSession, self.trees, self.bins, self.bins.of_zero()
        n = self.counts.sum(axis=1, keepdims=True)
        shares = np.where(n > 0, self.counts / np.maximum(n, 1), 0.0)
        shared = spark.sparkContext.broadcast((self.feature, self.bin, self.left, shares))

        @F.arrow_udf("array<double>")
        def voted(indices: pa.Array, values: pa.Array) -> pa.Array:
            feature, bin_, left, shares = shared.value
            starts, columns = _row_starts(indices), np.asarray(indices.flatten())
            codes = bins.codes(columns, np.asarray(values.flatten()), zero)
            out = np.zeros((len(indices), shares.shape[1]))
            for a, b, flat in _dense(starts, columns, codes, bins.width, 8 * trees):
                nodes = np.tile(np.arange(trees), b - a)
                row = np.repeat(np.arange(b - a), trees)
                inner = np.flatnonzero(feature[nodes] >= 0)
                while len(inner):
                    at = nodes[inner]
                    column = feature[at]
                    code = flat[row[inner] * bins.width + column].astype(np.int64)
                    nodes[inner] = left[at] + (np.where(code == 0, zero[column], code - 1) > bin_[at])
                    inner = inner[feature[nodes[inner]] >= 0]
                out[a:b] = shares[nodes].reshape(b - a, trees, -1).sum(axis=1)
            # A tree that was given no rows has no share in any class.
            out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
            return pa.array(list(out), pa.list_(pa.float64()))

        voices = dataset.withColumn("probability", voted(*_sparse(F.col(self.features))))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return voices.withColumn("prediction", best.cast("double")).withColumn(
            "probability", array_to_vector("probability"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: SparseForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(model, path, spark, {"features": model.features})
        spark.createDataFrame(pa.table({
            "node": np.arange(len(model.feature)), "feature": model.feature, "bin": model.bin, "left": model.left,
            "counts": pa.array(list(model.counts), pa.list_(pa.float64())),
        })).write.parquet(f"{path}/nodes")
        cuts = np.split(model.bins.thresholds, model.bins.starts[1:-1])
        spark.createDataFrame(pa.table({
            "idx": np.arange(model.bins.width), "cuts": pa.array(cuts, pa.list_(pa.float64())),
        })).write.parquet(f"{path}/bins")


class _Reader(MLReader):
    def load(self, path: str) -> SparseForestModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        nodes = spark.read.parquet(f"{path}/nodes").toArrow().sort_by("node")
        cuts = spark.read.parquet(f"{path}/bins").toArrow().sort_by("idx")["cuts"].combine_chunks()
        bins = Bins(np.asarray(cuts.flatten()), _row_starts(cuts))
        counts = np.asarray(nodes["counts"].combine_chunks().flatten()).reshape(nodes.num_rows, -1)
        arrays = (np.asarray(nodes[x]) for x in ("feature", "bin", "left"))
        model = SparseForestModel(*arrays, counts, bins, metadata["features"])
        model._resetUid(metadata["uid"])
        return model
