import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from casegrain.operators import forest
from casegrain.operators.classify import classifiers, load_model, save_model
from casegrain.operators.forest import Bins, SparseForest, best_splits, pruned, thresholds_of

SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType())])


@pytest.fixture(scope="module")
def table():
    """Sparse and dense rows, values on both sides of zero; the sign of two columns gives the class."""
    rng = random.Random(5)
    out = []
    for i in range(300):
        row = [rng.choice([-2.0, -1.0, 0.0, 0.0, 0.0, 0.5, 3.0]) for _ in range(9)]
        y = 0 if row[2] < 0 else 1 if row[5] > 0 else 2
        kept = {j: x for j, x in enumerate(row) if x}
        out.append((i, Vectors.dense(row) if i % 3 else Vectors.sparse(9, kept), float(y)))
    return out


@pytest.fixture(scope="module")
def rows(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(4).cache()


def answers(model, rows):
    found = model.transform(rows).select("id", "prediction", vector_to_array("probability").alias("p"))
    return {r.id: (r.prediction, [round(x, 9) for x in r.p]) for r in found.collect()}


def test_thresholds():
    assert thresholds_of(np.array([1.0, 2.0, 2.0]), 5, 32) == [0.5, 1.5]
    assert thresholds_of(np.array([-1.0, 1.0]), 2, 32) == [0.0]
    assert thresholds_of(np.array([4.0, 4.0]), 2, 32) == []
    # Four bins over 0 to 99: cuts near a quarter, half and three quarters.
    assert thresholds_of(np.arange(100.0)[1:], 100, 4) == pytest.approx([25, 50, 75], abs=1)
    many = np.random.default_rng(3).random(5000)
    assert len(thresholds_of(many, 100_000, 32)) <= 31


def test_codes_leave_out_the_bin_of_zero():
    bins = Bins(np.array([-1.5, 0.25, 2.0, 0.5]), np.array([0, 3, 3, 4]))
    zero = bins.of_zero()
    assert zero.tolist() == [1, 0, 0]
    columns, values = np.array([0, 0, 0, 0, 1, 2, 2]), np.array([-2.0, 0.1, 2.0, 2.1, 9.0, 0.5, 0.6])
    assert bins.codes(columns, values, zero).tolist() == [1, 0, 3, 4, 0, 0, 2]


def plain_best(x, y, w, drawn, bins, classes):
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    total, best = np.bincount(y, w, classes), (0.0, None)
    for place, f in enumerate(drawn):
        for b in range(bins):
            left = np.bincount(y[x[:, f] <= b], w[x[:, f] <= b], classes)
            right = total - left
            if left.sum() and right.sum():
                gain = gini(total) - (left.sum() * gini(left) + right.sum() * gini(right)) / total.sum()
                if gain > best[0] + 1e-12:
                    best = (gain, (place, b, left.tolist()))
    return best


def test_best_splits_equal_brute_force():
    rng = np.random.default_rng(1)
    bins, classes, k, width = 5, 3, 4, 11
    zero = rng.integers(0, bins, width)
    parts, expected, totals, drawn = [], [], [], []
    for node in range(40):
        n = rng.integers(2, 30)
        x = np.where(rng.random((n, width)) < 0.6, zero, rng.integers(0, bins, (n, width)))
        y, w = rng.integers(0, classes, n), rng.integers(1, 4, n)
        columns = rng.choice(width, k, replace=False)
        totals.append(np.bincount(y, w, classes))
        drawn.append(columns)
        expected.append(plain_best(x, y, w, columns, bins, classes))
        for place, f in enumerate(columns):
            for i in np.flatnonzero(x[:, f] != zero[f]):
                parts.append((((node * k + place) * bins + x[i, f]) * classes + y[i], w[i]))
    rng.shuffle(parts)
    key, weight = np.array(parts).T
    totals, drawn = np.array(totals, float), np.array(drawn)
    node, feature, bin_, left = best_splits(key, weight, totals, drawn, bins, zero)
    assert node.tolist() == [i for i, (gain, _) in enumerate(expected) if gain > 0]
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    for i, f, b, counts in zip(node, feature, bin_, left):
        other = totals[i] - counts
        gain = gini(totals[i]) - (counts.sum() * gini(counts) + other.sum() * gini(other)) / totals[i].sum()
        assert gain == pytest.approx(expected[i][0])
        place, wanted_bin, wanted = expected[i][1]
        if f == drawn[i][place] and b == wanted_bin:
            assert counts.tolist() == wanted


def test_drawn_columns_differ_within_a_node():
    for width, k in ((5, 3), (300, 18), (10_000, 100), (70, 70)):
        drawn = forest._drawn(np.random.default_rng(2), 500, width, k)
        assert drawn.min() >= 0 and drawn.max() < width
        assert all(len(set(x)) == k for x in drawn.tolist())
        share = np.bincount(drawn.ravel(), minlength=width).mean()
        assert share == pytest.approx(500 * k / width)


def test_pruned_takes_back_splits_of_one_prediction():
    #        0 -> 1, 2;  1 -> 3, 4 (both class 0);  2 -> 5, 6 (classes 0 and 1)
    feature, left = np.array([7, 8, 9, -1, -1, -1, -1]), np.array([1, 3, 5, 0, 0, 0, 0])
    counts = np.array([[9, 3], [6, 1], [3, 2], [4, 0], [2, 1], [3, 0], [0, 2]], float)
    f, _, to, c = pruned(feature, np.zeros(7, int), left, counts, np.array([1, 3, 7]))
    assert f.tolist() == [7, -1, 9, -1, -1] and to[0] == 1 and to[2] == 3
    assert c.tolist() == [[9, 3], [6, 1], [3, 2], [3, 0], [0, 2]]


def test_trees_hold_their_rows_and_answer_like_plain_trees(spark, table, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "NODES_PER_PASS", 3)
    monkeypatch.setattr(forest, "ROWS_PER_PARTITION", 100)
    model = SparseForest(num_trees=7, max_depth=6, seed=3).fit(rows)
    assert model.trees == 7 and 200 < model.counts[:7].sum() / 7 < 400
    inner = np.flatnonzero(model.feature >= 0)
    assert np.array_equal(model.counts[inner], model.counts[model.left[inner]] + model.counts[model.left[inner] + 1])
    got = answers(model, rows)
    right = 0
    for ident, vector, y in table:
        x, votes = vector.toArray(), np.zeros(3)
        for node in range(7):
            while model.feature[node] >= 0:
                f = model.feature[node]
                cuts = model.bins.thresholds[model.bins.starts[f]:model.bins.starts[f + 1]]
                node = model.left[node] + (x[f] > cuts[model.bin[node]])
            votes += model.counts[node] / model.counts[node].sum()
        assert got[ident][1] == pytest.approx(votes / 7)
        assert got[ident][0] == int(np.argmax([round(v, 9) for v in got[ident][1]]))
        right += got[ident][0] == y
    assert right > 270
    save_model(model, str(tmp_path / "forest"))
    assert answers(load_model(str(tmp_path / "forest")), rows) == got


def test_one_tree_of_all_columns_separates_its_rows(rows):
    model = SparseForest(num_trees=1, max_depth=30, seed=1).fit(rows)
    leaves = model.counts[model.feature < 0]
    assert (np.count_nonzero(leaves, axis=1) == 1).all()


def test_a_single_class_and_constant_columns(spark):
    same = spark.createDataFrame([(i, Vectors.sparse(4, {1: 2.0}), 0.0) for i in range(5)], SCHEMA)
    assert {p for p, _ in answers(SparseForest(num_trees=4).fit(same), same).values()} == {0.0}
    two = spark.createDataFrame([(i, Vectors.sparse(4, {1: 2.0}), float(i % 2)) for i in range(6)], SCHEMA)
    assert len({tuple(p) for _, p in answers(SparseForest(num_trees=4).fit(two), two).values()}) == 1
    empty = spark.createDataFrame([(i, Vectors.sparse(4, {}), float(i % 2)) for i in range(6)], SCHEMA)
    assert len({tuple(p) for _, p in answers(SparseForest(num_trees=4).fit(empty), empty).values()}) == 1


def test_blocks_hold_only_what_is_not_zero(spark):
    """A row of a million columns costs its few values: the library's forest held a number per column."""
    width = 1_000_000
    wide = [(i, Vectors.sparse(width, {j * 1000 + i % 2: 1.0 + j for j in range(40)}), float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(wide, SCHEMA)
    bins = Bins(np.full(width, 0.5), np.arange(width + 1))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([v.indices for _, v, _ in wide], pa.list_(pa.int32())),
         pa.array([v.values for _, v, _ in wide], pa.list_(pa.float64())), pa.array([int(y) for *_, y in wide], pa.int32())],
        names=["indices", "values", "y"])
    make, schema = forest._to_blocks(bins, 3, 1), forest._BLOCK
    given = spark.createDataFrame(pa.Table.from_batches([batch])).coalesce(1)
    (block,) = given.mapInArrow(make, schema).collect()
    assert len(block.codes) == 400 * 40 and len(block.columns) == 4 * 400 * 40
    model = classifiers(400)["RandomForest"].setNumTrees(3).setMaxDepth(3).fit(df)
    assert len(answers(model, df)) == 400


def test_levels_are_removed_once_read(spark, rows, monkeypatch):
    made, gone = [], []
    path, drop = forest.fresh_path, forest.remove
    monkeypatch.setattr(forest, "fresh_path", lambda *a: made.append(path(*a)) or made[-1])
    monkeypatch.setattr(forest, "remove", lambda s, p: gone.append(p) or drop(s, p))
    SparseForest(num_trees=3, max_depth=4).fit(rows)
    assert len(made) > 2 and made == gone


def test_deep_levels_share_a_write(rows, monkeypatch):
    """The trees do not depend on how often the rows are written."""
    named, fresh = [], forest.fresh_path
    monkeypatch.setattr(forest, "fresh_path", lambda spark, name: named.append(name) or fresh(spark, name))

    def grown():
        named.clear()
        model = SparseForest(num_trees=3, max_depth=8, seed=3).fit(rows)
        return [x.tolist() for x in (model.feature, model.bin, model.left, model.counts)], named.count("forest-rows")

    trees, writes = grown()
    monkeypatch.setattr(forest, "LEVELS_TO_MOVE", 100)
    again, of_all_levels = grown()
    assert again == trees and of_all_levels == 8 > writes
