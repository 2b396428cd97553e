import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casegrain.llm import exact_dedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 50)), min_size=1, max_size=200, unique=True))
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    assert (exact_dedup.golomb_decode(len(values), *exact_dedup.golomb_encode(values)) == values).all()


def test_golomb_is_compact():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    _, _, quotients, rests = exact_dedup.golomb_encode(values)
    assert 8 * (len(quotients) + len(rests)) / len(values) < 64 - np.log2(len(values)) + 3


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            out.append((i, best, len(ids), i == best and left, hashlib.sha256(text.encode()).hexdigest()))
            left = left and i != best
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (None, "a"), (None, "n"), (None, "n"),
        (7, "same"), (7, "same"), (8, "x" * 100_000), (9, "x" * 100_000), (10, "é"), (11, "é")]


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_odd_rows(spark, parts, tmp_path):
    rows = ROWS + [(100 + i, f"copy {i % 3}") for i in range(600)]
    docs = spark.createDataFrame([(*r, True, "f") for r in rows], "doc_id long, text string, suspect boolean, fingerprint string")
    path = str(tmp_path / "docs")
    docs.repartition(parts).write.parquet(path)
    docs = spark.read.parquet(path)
    assert result(exact_dedup.equal_texts(docs)) == expected(rows)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect() if r["doc_id"] is not None) == sorted(
        (r[0], next(t or "" for i, t in rows if i == r[0])) for r in expected(rows) if r[3] and r[0] is not None)
    assert kept.where("doc_id IS NULL").count() == 1
    assert exact_dedup.equal_texts(docs.limit(0)).count() == 0


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(exact_dedup.equal_texts(docs)) == expected(rows)


def test_another_dealing_is_noticed(spark, tmp_path, monkeypatch):
    made = []
    kept = exact_dedup._suspect
    monkeypatch.setattr(exact_dedup, "_suspect", lambda *paths: made.append(kept(*paths)) or made[-1])
    docs = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    assert exact_dedup.equal_texts(docs).count() == 50
    other = spark.createDataFrame([(i, str(i + 1000)) for i in range(50)], "doc_id long, text string")
    with pytest.raises(Exception, match="dealt out differently"):
        other.selectExpr("xxhash64(text) AS f").select(made[0]("f")).collect()
