import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from casegrain.operators import squared_hinge
from casegrain.operators.classify import (
    TextPipeline,
    benchmark_classifiers,
    classifiers,
    load_model,
    predict,
    save_model,
    vectorise_splits,
)
from casegrain.operators.features import LabelCodes, class_weights, long_weights
from casegrain.operators.naive_bayes import fit_naive_bayes, predict_naive_bayes
from casegrain.operators.splitting import stratified_split
from casegrain.operators.squared_hinge import SquaredHingeSVC
from casegrain.operators.terms import computed_once

TOPICS = {
    "money": "wire bank transfer account payment cash".split(),
    "threat": "webcam video blackmail threat leak photo".split(),
    "shop": "parcel seller order refund store item".split(),
}
SHARED = "please help today someone told".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    table = []
    for label, words in TOPICS.items():
        for i in range(40):
            text = rng.choices(words, k=6) + rng.choices(SHARED, k=3)
            rng.shuffle(text)
            table.append((f"{label}{i}", label, " ".join(text)))
    df = spark.createDataFrame(table, "complaint_id string, primary_category string, cleaned_text string")
    return stratified_split(df).cache()


@pytest.fixture(scope="module")
def splits(rows):
    return vectorise_splits(rows)


def test_label_codes_and_unseen_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "l string")
    codes = LabelCodes.fit(df, "l")
    assert codes.labels == ["a", "b", "c"] and codes.counts == [2, 1, 1]
    out = df.select("l", codes.encode(F.col("l")).alias("y")).withColumn("back", codes.decode(F.col("y")))
    assert {(r.l, r.y, r.back) for r in out.collect()} == {("a", 0, "a"), ("b", 1, "b"), ("c", 2, "c")}
    with pytest.raises(PySparkException, match="unseen label"):
        spark.createDataFrame([("z",)], "l string").select(codes.encode(F.col("l"))).collect()


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "l string")
    assert {r.l: r.class_weight for r in class_weights(df, "l").collect()} == {"a": 4 / 6, "b": 2.0}


def test_unfitted_pipeline_is_an_error(rows):
    with pytest.raises(RuntimeError):
        TextPipeline().vectors(rows, ["complaint_id"])


def test_rows_without_known_terms_keep_an_empty_vector(spark, rows):
    pipeline = TextPipeline().fit(rows.where("split = 'train'"))
    odd = spark.createDataFrame([("x", "zzz qqq"), ("y", ""), ("z", "bank")], "complaint_id string, cleaned_text string")
    sizes = {r.complaint_id: len(r.vector) for r in pipeline.vectors(odd, ["complaint_id"]).collect()}
    assert sizes == {"x": 0, "y": 0, "z": 1}


def test_naive_bayes_equals_brute_force(rows):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    pipeline = TextPipeline().fit(train)
    size = pipeline.tfidf.size()
    keys = ["complaint_id", "primary_category"]
    vectors = pipeline.vectors(train, keys)
    model = fit_naive_bayes(vectors, "primary_category", size, pipeline.codes)
    got = {r.complaint_id: r for r in predict_naive_bayes(pipeline.vectors(test, keys), model, pipeline.tfidf).collect()}

    def matrix(df):
        ids, labels, out = [], [], []
        for r in df.collect():
            v = np.zeros(size)
            for x in r.vector:
                v[x.idx] = x.weight
            assert np.linalg.norm(v) == pytest.approx(1)
            ids.append(r.complaint_id), labels.append(r.primary_category), out.append(v)
        return ids, np.array(labels), np.array(out)

    _, labels, x = matrix(vectors)
    names = sorted(set(labels))
    mass = np.array([x[labels == c].sum(axis=0) + 0.1 for c in names])
    log_p = np.log(mass) - np.log(mass.sum(axis=1, keepdims=True))
    prior = np.log([(labels == c).mean() for c in names])
    ids, _, x = matrix(pipeline.vectors(test, keys))
    joint = x @ log_p.T + prior
    p = np.exp(joint - joint.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for i, ident in enumerate(ids):
        assert got[ident].prediction == names[int(p[i].argmax())]
        assert got[ident].confidence == pytest.approx(100 * p[i].max(), rel=1e-9)


def test_texts_are_cut_into_words_once(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    lazy = computed_once(rows, "cleaned_text", F.udf(counted, "string")(F.col("cleaned_text")))
    got = vectorise_splits(lazy)
    assert got.train.count() + got.val.count() + got.test.count() == rows.count()
    assert read.value == rows.count()


def test_split_ranks_leave_costly_columns_alone(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    plain = rows.drop("split")
    lazy = computed_once(plain, "cleaned_text", F.udf(counted, "string")(F.col("cleaned_text")))
    out = stratified_split(lazy, keys=plain.select("complaint_id", "primary_category")).collect()
    assert {(r.complaint_id, r.split) for r in out} == {
        (r.complaint_id, r.split) for r in stratified_split(plain).collect()}
    assert read.value == len(out)


def test_blocks_are_bytes_and_hold_the_rows():
    batch = pa.RecordBatch.from_arrays(
        [pa.array([[0, 2], [], [1]], pa.list_(pa.int32())), pa.array([[0.5, 1.5], [], [2.0]]), pa.array([1, 0, 1], pa.int32())],
        names=["indices", "values", "y"])
    (block,) = squared_hinge._blocks(iter([batch]))
    assert all(kind == pa.binary() for kind in block.schema.types)
    rows, indices, values, y = (
        np.frombuffer(block.column(i)[0].as_buffer(), kind) for i, kind in enumerate(squared_hinge._KINDS))
    assert rows.tolist() == [0, 0, 2] and indices.tolist() == [0, 2, 1] and y.tolist() == [1, 0, 1]
    assert values.tolist() == [0.5, 1.5, 2.0]


def test_stored_vectors_equal_the_long_weights(rows, splits):
    stored = {r.complaint_id: r.features for r in splits.test.collect()}
    long = long_weights(splits.pipeline.vectors(rows.where("split = 'test'"), ["complaint_id"])).collect()
    assert len(long) == sum(v.numNonzeros() for v in stored.values())
    for r in long:
        assert stored[r.complaint_id][int(r.idx)] == pytest.approx(r.weight)


def test_classifier_benchmark(splits):
    table, models, seconds = benchmark_classifiers(splits, classifiers_small(splits))
    rows = table.collect()
    assert [r.model for r in rows] and set(models) == set(seconds) == {r.model for r in rows}
    scores = [r.test_macro_f1 for r in rows]
    assert scores == sorted(scores, reverse=True) and min(scores) > 0.8


def classifiers_small(splits):
    models = classifiers(splits.train.count())
    models["RandomForest"].setNumTrees(20).setMaxDepth(8)
    return models


def test_models_and_pipeline_saved_and_loaded(spark, rows, splits, tmp_path):
    model = classifiers(1)["MultinomialNB"].fit(splits.train)
    save_model(model, str(tmp_path / "model"))
    splits.pipeline.save(str(tmp_path / "pipeline"))
    pipeline = TextPipeline.load(spark, str(tmp_path / "pipeline"))
    again = pipeline.transform(rows.where("split = 'test'"), ["complaint_id", "primary_category"])
    answers = lambda m, df: sorted((r.complaint_id, r.predicted, round(r.confidence, 6)) for r in predict(m, df, pipeline.codes).collect())
    assert answers(load_model(str(tmp_path / "model")), again) == answers(model, splits.test)


def test_confidence_is_100_without_probabilities(splits):
    svm = classifiers(splits.train.count())["LinearSVC"].fit(splits.train.withColumn("weight", F.lit(1.0)))
    rows = predict(svm, splits.test, splits.pipeline.codes).collect()
    assert {r.confidence for r in rows} == {100.0}
    assert np.mean([r.predicted == r.primary_category for r in rows]) > 0.9


def dense_solution(x, y, classes, c=1.0):
    """Newton's method on the one-vs-rest squared hinge problem, to the last digit."""
    x = np.hstack([x, np.ones((len(x), 1))])
    out = []
    for k in range(classes):
        t = np.where(y == k, 1.0, -1.0)
        cost = c * np.where(y == k, len(y) / (classes * (y == k).sum()), 1.0)
        w = np.zeros(x.shape[1])
        value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - t * (x @ v)) ** 2).sum()  # noqa: B023, E731
        for _ in range(100):
            slack = 1 - t * (x @ w)
            on = slack > 0
            gradient = w - 2 * (cost * t * np.maximum(slack, 0)) @ x
            hessian = np.eye(len(w)) + 2 * (x[on] * cost[on][:, None]).T @ x[on]
            step, size = np.linalg.solve(hessian, -gradient), 1.0
            while value(w + size * step) > value(w) and size > 1e-9:
                size /= 2
            w = w + size * step
        out.append(w)
    return np.array(out)


def test_squared_hinge_machine_equals_dense_solution(spark, splits, tmp_path):
    train = splits.train.collect()
    x, y = np.array([r.features.toArray() for r in train]), np.array([int(r.y) for r in train])
    expected = dense_solution(x, y, 3)
    model = SquaredHingeSVC().fit(splits.train.repartition(5))
    assert np.abs(model.weights - expected).max() < 1e-3
    test = {r.complaint_id: r for r in model.decisions(splits.test).collect()}
    for r in splits.test.collect():
        plain = expected[:, :-1] @ r.features.toArray() + expected[:, -1]
        assert np.allclose(test[r.complaint_id].decisions, plain, atol=1e-3)
    save_model(model, str(tmp_path / "svm"))
    answers = lambda m: sorted(map(tuple, m.transform(splits.test).select("complaint_id", "prediction").collect()))
    assert answers(load_model(str(tmp_path / "svm"))) == answers(model)


def test_many_partial_gradients_are_summed_in_tasks(splits, monkeypatch):
    expected = SquaredHingeSVC().fit(splits.train).weights
    monkeypatch.setattr(squared_hinge, "PARTS_ON_DRIVER", 2)
    monkeypatch.setattr(squared_hinge, "ROWS_PER_BLOCK", 7)
    assert np.abs(SquaredHingeSVC().fit(splits.train.repartition(6)).weights - expected).max() < 2e-3


def test_within_margin_equals_brute_force():
    rng = np.random.default_rng(4)
    x = np.where(rng.random((30, 6)) < 0.3, rng.normal(size=(30, 6)), 0.0)
    x[[0, 7, 29]] = 0.0
    y, w = rng.integers(0, 3, 30).astype(np.int32), rng.normal(size=7)
    rows, indices = np.nonzero(x)
    block = (rows.astype(np.int32), indices.astype(np.int32), x[rows, indices], y)
    first, none = squared_hinge._first_entries(block[0]), np.zeros(0)
    for k in range(3):
        slack = 1 - np.where(y == k, 1, -1) * (x @ w[:-1] + w[-1])
        part, found = squared_hinge.within_margin(block, first, w, k)
        dense = np.zeros((len(found), 6))
        dense[part[0], part[1]] = part[2]
        assert np.allclose(found, slack[slack > 0]) and np.allclose(dense, x[slack > 0])
        assert part[3].tolist() == y[slack > 0].tolist()
        hessian = 2 * 0.5 * dense.T * np.where(part[3] == k, 3.0, 1.0) @ dense
        column = squared_hinge.curved(part, k, np.append(w[:-1], 0.0), np.full(3, 3.0), 0.5)
        assert np.allclose(column[:-1], hessian @ w[:-1])
    empty = (*(none.astype(np.int32),) * 2, none, none.astype(np.int32))
    part, found = squared_hinge.within_margin(empty, squared_hinge._first_entries(empty[0]), w, 0)
    assert not len(found) and not squared_hinge.curved(part, 0, w, np.ones(3), 1.0).any()


def test_conjugate_gradients_solve_each_row_alone(monkeypatch):
    rng = np.random.default_rng(8)
    matrices = [np.eye(5) + (a := rng.normal(size=(5, 5))) @ a.T for _ in range(3)]
    gradient = rng.normal(size=(3, 5))
    gradient[1] = 0.0
    asked = []

    def product(p, going):
        asked.append(going.tolist())
        return np.array([m @ x if on else np.zeros(5) for m, x, on in zip(matrices, p, going)])

    monkeypatch.setattr(squared_hinge, "ROUGHLY", 1e-12)
    diagonal = np.array([np.diag(m) for m in matrices])
    found = squared_hinge.conjugate_gradients(product, gradient, diagonal, 1e-9)
    assert np.allclose(found, [-np.linalg.solve(m, g) for m, g in zip(matrices, gradient)], atol=1e-6)
    assert asked and not any(going[1] for going in asked)


def test_squared_hinge_machine_takes_few_passes_over_all_rows(spark, monkeypatch):
    """Columns as unlike in size as frequent and rare words, and rows that weigh much."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 40)) * np.geomspace(1, 0.01, 40)
    x[np.arange(300), y] += 1.0
    table = [(float(k), Vectors.dense(row)) for k, row in zip(y, x)]
    passes, over_all = [], squared_hinge._Problem.__call__
    monkeypatch.setattr(
        squared_hinge._Problem, "__call__", lambda self, weights: passes.append(1) or over_all(self, weights))
    df = spark.createDataFrame(table, ["y", "features"])
    weights = SquaredHingeSVC(c=100.0).fit(df).weights
    assert np.abs(weights - dense_solution(x, y, 3, 100.0)).max() < 1e-3
    assert len(passes) <= 30


def test_log_of_smoothing_is_the_floor(rows):
    train = rows.where("split = 'train'")
    pipeline = TextPipeline().fit(train)
    vectors = pipeline.vectors(train, ["complaint_id", "primary_category"])
    model = fit_naive_bayes(vectors, "primary_category", pipeline.tfidf.size(), pipeline.codes)
    assert model.prior == pytest.approx([math.log(1 / 3)] * 3)
    assert all(f < 0 for f in model.floor)
