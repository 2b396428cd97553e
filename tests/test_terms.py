import random
from collections import Counter

import pyarrow as pa

from casegrain.operators import terms as t
from casegrain.operators.features import counted_terms, fit_tfidf, unit_vectors
from casegrain.operators.inverted import Layout, write_document_blocks
from casegrain.operators.retrieval import bm25_index, document_terms
from casegrain.operators.vocabulary import _Counter
from casegrain.workspace import fresh_path, written

ROWS = [["b", "a", "a", "ab", "a"], [], None, ["zz"], ["é", "a", "b", "a", "b"]]


def pairs(words):
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def test_terms_are_counted_as_numbers_and_come_in_byte_order(spark):
    df = spark.createDataFrame(list(enumerate(ROWS)), "i int, words array<string>")
    plan = counted_terms(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan
    got = {r.i: [(x.term, x.tf) for x in r.terms] for r in counted_terms(df).collect()}
    for i, words in enumerate(ROWS):
        assert got[i] == sorted(Counter(pairs(words or [])).items(), key=lambda x: x[0].encode())


def test_words_give_the_vectors_of_their_counted_terms(spark):
    rng = random.Random(3)
    rows = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))] for _ in range(200)]
    df = spark.createDataFrame([*enumerate(rows), (200, None), (201, ["unseen"])], "i int, words array<string>")
    model = fit_tfidf(df.where("i < 200"), max_features=60, min_df=2)
    found = lambda given: {r.i: r.vector for r in unit_vectors(given, model).collect()}
    assert found(df) == found(counted_terms(df)) and found(df)[200] == found(df)[201] == []


def test_a_batch_is_taken_in_pieces_of_bounded_size():
    lists = pa.array([["a"] * 3, None, ["b"] * 9, [], ["c"], ["d"] * 2], pa.list_(pa.string()))
    assert [len(p.flatten()) for p in t.runs_of_rows(lists, 4)] == [3, 9, 3]
    assert [x for p in t.runs_of_rows(lists, 4) for x in p.to_pylist()] == lists.to_pylist()


def test_a_task_holds_no_more_words_than_its_terms_need():
    counter = _Counter(held=50)
    for i in range(40):
        counter.add(pa.array([[f"w{i}_{j}" for j in range(20)] + ["often"] * 5], pa.list_(pa.string())))
    counter.merge()
    assert len(counter.terms) <= 50 and len(counter.words) <= 100
    assert "often" in counter.named().to_pylist()


def test_blocks_are_cut_where_their_documents_are(spark):
    """No shuffle of single postings: each slice's documents move whole, and only blocks after that."""
    rows = [(i, ["a", "b", "a"] if i % 2 else ["b", f"w{i}"]) for i in range(300)] + [(300, [])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    forward = written(document_terms(docs), "forward")
    blocks = write_document_blocks(forward, "tf", lambda tf, n: tf / n, Layout(4, 3), fresh_path(spark, "blocks"))
    found = {(r.term, d): (v, n) for r in blocks.collect() for d, v, n in zip(r.docs, r.values, r.lens)}
    assert found == {(t, i): (float(words.count(t)), len(words)) for i, words in rows for t in words}
    assert all(r.top == max(v / n for v, n in zip(r.values, r.lens)) for r in blocks.collect())
    index = bm25_index(docs)
    assert {r.term: r.df for r in index.terms.collect()} == {
        t: sum(t in words for _, words in rows) for t in {t for _, words in rows for t in words}}


def test_a_document_without_a_term_and_an_empty_index(spark):
    for rows in ([(1, "")], []):
        index = bm25_index(spark.createDataFrame(rows, "doc_id long, text string"))
        assert index.terms.count() == index.postings().count() == 0
        assert index.stats().first().n_docs == len(rows)
