import numpy as np
import pytest

from casegrain.operators.approximate import VectorIndex
from casegrain.operators.dense import dense_search
from casegrain.plans import all_queries


def recall(approximate, exact):
    pairs = lambda df: {(r["qid"], r["doc_id"]) for r in df.collect()}
    wanted = pairs(exact)
    return len(pairs(approximate) & wanted) / len(wanted)


def test_recall_of_the_registered_query(spark, data):
    queries = all_queries.QUERIES
    assert recall(queries["search_approximate"](spark, data), queries["search_dense"](spark, data)) >= 0.9


def made(seed, n, width, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    rows = centres[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("width, options", [(32, {}), (30, {"piece_rows": 40, "sample": 500}), (8, {"cells": 400})])
def test_recall_on_clusters(spark, width, options):
    """A width that parts do not divide, cells in pieces, more cells than differ much."""
    rows = made(1, 3000, width)
    frame = lambda ids, name: spark.createDataFrame(
        [(int(i), rows[i].tolist()) for i in ids], f"{name} long, vector array<double>")
    docs, queries = frame(range(3000), "doc_id"), frame(range(0, 3000, 60), "qid")
    index = VectorIndex.build(docs, **options)
    assert index.rows.count() == 3000
    found = index.search(queries, 20, probes=None if "cells" not in options else 250)
    assert recall(found, dense_search(queries, docs, 20)) >= 0.9
    for r in found.limit(50).collect():
        assert r["score"] == pytest.approx(rows[r["qid"]] @ rows[r["doc_id"]], abs=2e-6)


def test_odd_vectors(spark):
    """Copies, null vectors, fewer rows than results, nothing to index."""
    docs = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0])], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("n", None)], "qid string, vector array<double>")
    rows = VectorIndex.build(docs).search(queries, 5).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [("q", 1, 1, 1.0), ("q", 2, 2, 1.0), ("q", 3, 4, 0.0)]
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(docs.limit(0))
