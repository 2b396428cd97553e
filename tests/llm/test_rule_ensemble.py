import math
import random
import re
import unicodedata
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from casegrain.llm import rule_ensemble as re_
from casegrain.workspace import written

CATEGORY = {"L": str.isalpha}


def plain_statistics(text):
    """The statistics by plain Python."""
    t = text or ""
    n = len(t)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = t.split("\n")
    share = lambda good: sum(map(good, t)) / max(1, n)
    kind = unicodedata.category
    return {
        "log_chars": math.log(1 + n), "log_words": math.log(1 + len(words)), "word_length": n / max(1, len(words)),
        "line_length": n / len(lines), "distinct_words": len(set(words)) / max(1, len(words)),
        "distinct_lines": len(set(lines)) / len(lines), "upper": share(lambda c: kind(c) == "Lu"),
        "digits": share(lambda c: c in "0123456789"), "marks": share(lambda c: c in ".,;:!?"),
        "symbols": share(lambda c: kind(c)[0] not in "LN" and c not in " \t\n\x0b\f\r" and c not in ".,;:!?"),
        "commas": share(lambda c: c == ","), "exclamations": share(lambda c: c == "!"),
    }


def plain_score(model, stats):
    holds = lambda r: all(stats[s] <= v if way == "<=" else stats[s] > v for s, way, v in r)
    return 1 / (1 + math.exp(-(model.bias + sum(w for r, w in model.rules if holds(r)))))


def made(n=700, seed=5):
    """Prose, shouting, repeated words and symbol noise; what is not prose is of low quality."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    texts = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        kind = rng.choice(["prose", "prose", "shout", "repeat", "noise"])
        if kind == "shout":
            words = [w.upper() + "!!" for w in words]
        if kind == "repeat":
            words = [words[0]] * len(words)
        if kind == "noise":
            words = [w + rng.choice(["###", "$$$", " |"]) for w in words]
        texts.append((i, " ".join(words) + ".\n" + word() + ", end.", int(kind == "prose")))
    return texts


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    stats = written(re_.statistics(docs), "test-statistics")
    return rows, stats, re_.train(stats, labels)


def test_statistics_equal_plain_python(spark):
    texts = [None, "", " ", "\n\n", "A b, a B!\n12 x\n12 x", "É ß $$ | „q“", "word " * 20_000, "x" * 100_000]
    rows = re_.statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for row in rows.collect():
        for name, value in plain_statistics(texts[row["doc_id"]]).items():
            assert row[name] == pytest.approx(value, abs=1e-12), (name, row["doc_id"])


def test_held_out_rows_are_told_apart(fitted):
    rows, stats, model = fitted
    quality = {r[0]: r[2] for r in rows}
    out = re_.scored(stats, model).collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_compiled_column_equals_the_rules(fitted):
    rows, stats, model = fitted
    texts = {r[0]: r[1] for r in rows}
    assert model.rules and all(len({s for s, _, _ in r}) >= 1 for r, _ in model.rules)
    for row in re_.scored(stats, model).limit(200).collect():
        assert row["score"] == pytest.approx(plain_score(model, plain_statistics(texts[row["doc_id"]])), abs=1e-9)


def test_weights_are_the_lasso_solution(fitted):
    """At the optimum the mean log loss pulls each kept weight exactly as hard as its penalty."""
    rows, _, model = fitted
    learned = [r for r in rows if crc32(str(r[0]).encode()) % 5]
    n, good = len(learned), sum(r[2] for r in learned)
    total = n / 2
    fit = [(plain_statistics(t), y, total / good if y else total / (n - good)) for _, t, y in learned]
    holds = lambda r, s: all(s[k] <= v if way == "<=" else s[k] > v for k, way, v in r)
    whole = sum(w for _, _, w in fit)
    for rule, weight in model.rules:
        x = [holds(rule, s) for s, _, _ in fit]
        mean = sum(w * a for (_, _, w), a in zip(fit, x)) / whole
        deviation = math.sqrt(mean * (1 - mean) * whole / (whole - 1))
        pull = sum(w * (plain_score(model, s) - y) * a for (s, y, w), a in zip(fit, x)) / whole
        assert pull == pytest.approx(-math.copysign(re_.LASSO * deviation, weight), abs=2e-4)


def test_paths_of_a_printed_tree():
    tree = """DecisionTreeRegressionModel: uid=x, depth=2, numNodes=5, numFeatures=12
  If (feature 0 <= 2.5)
   If (feature 3 <= 0.125)
    Predict: 1.0
   Else (feature 3 > 0.125)
    Predict: 0.0
  Else (feature 0 > 2.5)
   Predict: -1.0
"""
    low, high = ("log_chars", "<=", 2.5), ("log_chars", ">", 2.5)
    found = list(re_.paths(tree))
    assert found == [(low,), (low, ("line_length", "<=", 0.125)), (low, ("line_length", ">", 0.125)), (high,)]
    assert len(re_.distinct_rules(found)) == 3  # a rule and its opposite carry the same
    narrow = (low, ("log_chars", "<=", 1.0), high, ("log_chars", ">", 0.5))
    assert re_.merged(narrow) == (("log_chars", "<=", 1.0), ("log_chars", ">", 2.5))


def test_odd_rows(spark):
    """Null and empty texts, null and repeated ids, clashing columns, labels that are null, unknown or contradict."""
    rows = [(1, None, 0.5), (1, "", 0.5), (None, "text", 0.5), (2, "Some text.", 0.5), (2, "Some text.", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    schema = "doc_id long, quality int, upper int"
    labels = spark.createDataFrame([(2, 1, 1), (2, None, 1), (None, 0, 1), (9, 3, 1)], schema)
    stats = written(re_.statistics(docs), "test-odd")
    model = re_.train(stats, labels)
    assert model.rules == () and model.score() is not None
    out = re_.scored(stats, model).collect()
    assert len(out) == 5 and len({r["score"] for r in out}) == 1
    both = spark.createDataFrame([(2, 1, 1), (2, 0, 1), (1, 1, 1)], schema)
    model = re_.train(stats, both)  # few rows: a constant or a rule, but a score
    assert re_.scored(stats, model).where(F.col("score").between(0, 1)).count() == 5
    empty = written(re_.statistics(docs.limit(0)), "test-empty")
    assert re_.scored(empty, re_.train(empty, labels)).count() == 0
