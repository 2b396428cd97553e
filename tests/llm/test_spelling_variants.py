import random
from collections import Counter

import pytest

from casegrain.llm import spelling_variants as sv


def one_edit_apart(one, other):
    """By definition: one inserted, deleted or replaced code point."""
    if len(one) > len(other):
        one, other = other, one
    if len(one) == len(other):
        return sum(a != b for a, b in zip(one, other)) == 1
    return len(one) + 1 == len(other) and any(one == other[:i] + other[i + 1:] for i in range(len(other)))


def expected(counts, at_least=2):
    near = {w: [x for x in counts if one_edit_apart(w, x)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[word] = best if best is not None and counts[best] >= at_least * counts[word] else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, n, form[word], root, len(near[word]), counts[form[word]] if form[word] else None))
    return sorted(out)


def grouped(spark, counts, **options):
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    rows = sv.variant_groups(words, **options).select("word", "n", "form", "root", "n_near", "form_n").collect()
    return sorted(map(tuple, rows))


def made(seed, n, letters="abé", lengths=(5, 8)):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(*lengths))): rng.choice([3, 4, 7, 9, 20, 50, 400])
            for _ in range(n)}


@pytest.mark.parametrize("piece", [4096, 3])
def test_dense_vocabularies(spark, piece):
    """Short alphabets: doubled letters at the halves' border, ties, chains; crowded groups with the small piece."""
    counts = made(1, 250)
    assert grouped(spark, counts, piece=piece) == expected(counts)


def test_longer_words_and_chains(spark):
    words = ["colour", "color", "colours", "kolour", "colouur", "collour", "ccolour", "coloure", "honour", "honor",
             "aaaaa", "aaaaaa", "aaaaaaa", "aabaaa", "x" * 3000, "x" * 2999 + "y", "x" * 3001]
    counts = {w: 3 * 2 ** (i % 7) for i, w in enumerate(words)}
    assert grouped(spark, counts) == expected(counts)
    assert grouped(spark, {}) == []


def test_index_moves_all_words_in_parallel():
    rests, longer = ["abc", "abd", "ab", "bc", "xbc", "abcd"[:3]], [True, True, False, False, True, True]
    index = sv.PositionIndex(rests, longer)
    names = lambda bits: [i for i in range(len(rests)) if bits >> i & 1]
    assert names(index.of_longer("abc")) == [1, 2, 3, 4]
    assert names(index.of_shorter("ab")) == [0, 1, 5]
    # Behind a common second half that starts with the border's letter these pairs belong to the other half's group.
    assert names(index.of_longer("abc", "c")) == [1, 3, 4]
    assert names(index.of_shorter("ab", "c")) == [1]


def test_words_of_a_text():
    assert sv.words_of(1, "Größe, GRÖSSE größe 12ab".encode(), None) == Counter(
        {"größe": 2, "grÖsse": 1, "ab": 1})
    erased = [w for i in range(400) for w in sv.words_of(i, b"Letters letters")]
    assert "letters" in erased and {len(w) for w in erased} == {6, 7}
    # Both occurrences in a document are mistyped alike.
    assert all(sum(sv.words_of(i, b"Letters letters").values()) == 2 for i in range(400))


def test_odd_rows(spark):
    """Null and empty texts, a null id, repeated rows, a long text, columns named like the operator's own."""
    rows = [(1, "alpha alpha"), (1, "alpha alpha"), (None, "alphas"), (2, None), (3, ""), (4, "alphas, alphas!"),
            (5, "alphax " * 30_000)]
    docs = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, n int, key string")
    words = sv.vocabulary(docs)
    assert sorted(map(tuple, words.collect())) == [("alpha", 4), ("alphas", 3), ("alphax", 30_000)]
    got = {r["word"]: r for r in sv.variant_groups(words).collect()}
    assert (got["alpha"]["form"], got["alpha"]["n_near"], got["alphas"]["root"]) == ("alphax", 2, "alphax")
    assert sv.vocabulary(docs.limit(0)).count() == 0
    assert sv.variant_groups(sv.vocabulary(docs.limit(0))).count() == 0
