import random

import pytest

from casegrain.operators.segments import Commit, SegmentedIndex
from tests.test_retrieval import WORDS, brute_bm25, lists_of

QUERIES = [("q1", "wire fraud"), ("q2", "été bank money"), ("q3", "unknown")]


def texts(seed, ids):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def check(spark, index, docs, **limits):
    queries = spark.createDataFrame(QUERIES, "qid string, text string")
    got = lists_of(index.search(queries, 4, **limits))
    for qid, text in QUERIES:
        expected = brute_bm25(list(docs.items()), text, 4)
        assert [d for d, _ in got.get(qid, [])] == [d for d, _ in expected]
        assert [s for _, s in got.get(qid, [])] == pytest.approx([s for _, s in expected], abs=2e-6)


def test_segments_equal_an_index_built_at_once(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    docs = texts(1, range(30))
    index.add(frame(spark, docs))
    for seed, ids in ((2, range(20, 40)), (3, range(35, 45))):  # some documents replaced, one of them twice
        more = texts(seed, ids)
        index.add(frame(spark, more))
        docs |= more
    check(spark, index, docs)
    check(spark, index, docs, open_at_once=0, lead_postings=3)
    _, before = index.pinned()
    assert len(before.segments) == 3 and set(before.tombstones) == set(before.segments[:2])
    index.compact()
    assert len(index.pinned()[1].segments) == 1
    check(spark, index, docs)
    # What was pinned before can still be read.
    old = SegmentedIndex(spark, str(tmp_path / "index"))
    old.pinned = lambda: (3, before)
    check(spark, old, docs)


def test_writers_that_come_second_try_again(spark, tmp_path):
    path = str(tmp_path / "index")
    one, other = SegmentedIndex(spark, path), SegmentedIndex(spark, path)
    first, second = texts(4, range(10)), texts(5, range(5, 15))
    stale = [(0, Commit())]
    newest = other.pinned
    other.pinned = lambda: stale.pop() if stale else newest()
    one.add(frame(spark, first))
    assert other.add(frame(spark, second)) == 2
    check(spark, one, first | second)


def test_a_batch_is_taken_in_once(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    docs = texts(6, range(8))
    assert index.add(frame(spark, docs), "s", 0) == 1
    assert index.add(frame(spark, docs), "s", 0) == 1
    assert index.add(frame(spark, texts(7, range(2))), "s", 1) == 2
    assert len(index.pinned()[1].segments) == 2


def test_empty_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    assert index.pinned() == (0, Commit()) and index.compact() == 0
    with pytest.raises(ValueError, match="no documents"):
        index.search(spark.createDataFrame(QUERIES, "qid string, text string"))
