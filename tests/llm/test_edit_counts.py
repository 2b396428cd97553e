import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casegrain.llm import edit_counts

COUNTS = edit_counts.piece_counts()
SOME = st.text(alphabet=st.sampled_from("ab' relvtsmdRE19.,!\n\t é😀½"), max_size=60)


def full(text):
    return len(COUNTS.encoding.encode_ordinary(text))


def sound(tree, text):
    half = tree.half
    assert tree.total == full(text)
    assert tree.chars[1] == len(text)
    for i in range(1, half):
        assert tree.chars[i] == tree.chars[2 * i] + tree.chars[2 * i + 1]
        assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]
    # Every leaf's text has the leaf's tokens.
    at = 0
    for chars, tokens in zip(tree.chars[half:], tree.tokens[half:]):
        assert tokens == full(text[at: at + chars]) if chars else tokens == 0
        at += chars


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab' relvtsmdRE19.,!\n\t é😀½"), max_size=1500),
       st.lists(st.tuples(st.integers(-3, 1600), st.integers(-1, 400), SOME), max_size=5))
def test_edits_equal_counting_again(text, edits):
    tree = edit_counts.Tree.of(text, COUNTS)
    sound_total = full(text)
    assert tree.total == sound_total
    for at, deleted, inserted in edits:
        at_ = min(max(at, 0), len(text))
        deleted_ = min(max(deleted, 0), len(text) - at_)
        expected = text[:at_] + inserted + text[at_ + deleted_:]
        text, tree, _ = edit_counts.edit(text, tree, at, deleted, inserted, COUNTS)
        assert text == expected
        assert tree.total == full(text) and tree.chars[1] == len(text)
        half = tree.half
        for i in range(1, half):
            assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


def test_only_the_touched_leaves_are_encoded_again():
    text = "some words, it's true; " * 5000
    tree = edit_counts.Tree.of(text, COUNTS)
    sound(tree, text)
    changed, new, encoded = edit_counts.edit(text, tree, 60_001, 7, "'ll see", COUNTS)
    assert encoded < 1500
    sound(new, changed)
    long, grown, _ = edit_counts.edit(changed, new, 10, 0, "a b " * 4000, COUNTS)
    sound(grown, long)
    short, less, _ = edit_counts.edit(long, grown, 5, len(long) - 10, "", COUNTS)
    sound(less, short)


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    trees = edit_counts.with_trees(docs)
    rows = edit_counts.after_edits(trees, edit_counts.touch_ups(F.col("text"))).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == full(text)
        n = len(text)
        for at, deleted, inserted in ((n // 3, 0, text[:30]), (n // 2, 20, ""), (max(n - 5, 0), 5, "'re done. ")):
            text = text[:at] + inserted + text[at + deleted:]
        assert r["text"] == text and r["edited_tokens"] == full(text) == r["tokens"][1]


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "word " * 40_000), (3, "x"), (3, "x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, tokens int")
    trees = edit_counts.with_trees(docs)
    assert sorted(r["n_tokens"] for r in trees.collect()) == sorted(full(t or "") for _, t in rows)
    kind = "array<struct<at:int,deleted:int,inserted:string>>"
    same = edit_counts.after_edits(trees, F.lit(None).cast(kind)).collect()
    assert all(r["edited_tokens"] == r["n_tokens"] and r["encoded_chars"] == 0 for r in same)
    assert edit_counts.after_edits(trees.limit(0), F.lit(None).cast(kind)).count() == 0
    assert np.array_equal(edit_counts._heap(np.array([1, 2, 3])), [0, 6, 3, 3, 1, 2, 3, 0])
