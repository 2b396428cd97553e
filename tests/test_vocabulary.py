import random
from collections import Counter

import pytest

from casegrain.operators.vocabulary import frequent_terms


def expected(rows, most, min_df):
    freq, df = Counter(), Counter()
    for words in rows:
        terms = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
        freq.update(terms)
        df.update(set(terms))
    found = sorted((t for t in freq if df[t] >= min_df), key=lambda t: (-freq[t], t.encode()))
    return [(t, freq[t], df[t]) for t in found[:most]]


def made(seed, n):
    """Few frequent words, many rare ones, and one that is frequent in a single row."""
    rng = random.Random(seed)
    rows = [[rng.choice("abcdefgh") if rng.random() < 0.6 else f"w{int(rng.paretovariate(0.7))}"
             for _ in range(rng.randint(0, 25))] for _ in range(n)]
    return [*rows, ["once"] * 400, []]


@pytest.mark.parametrize("most, min_df, options", [
    (20, 1, {}), (20, 2, {}), (20, 2, {"held": 60, "sent": 50}), (30, 2, {"held": 400, "sent": 90}),
    (30, 2, {"sent": 60, "candidates": 31}), (5000, 1, {"held": 50, "sent": 20}),
])
def test_bounds_give_the_exact_terms(spark, most, min_df, options):
    """Nothing dropped; terms dropped in tasks; too many candidates; fewer terms than wanted."""
    rows = made(7, 600)
    words = spark.createDataFrame([(r,) for r in rows], "words array<string>").repartition(6)
    assert sorted(map(tuple, frequent_terms(words, most, min_df, **options).collect())) == sorted(
        expected(rows, most, min_df))


def test_no_rows(spark):
    assert frequent_terms(spark.createDataFrame([], "words array<string>"), 5).count() == 0
