import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from casegrain.llm import kneser_ney as kn


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    return [*words, "</s>"]


class Plain:
    """The model from dictionaries, by its textbook formulas."""

    def __init__(self, texts, order):
        self.order = order
        grams = Counter()
        self.raw = Counter()
        for text in texts:
            seq = ["<s>"] * (order - 1) + tokens(text)
            self.raw.update(seq[order - 1:])
            grams.update(tuple(seq[i: i + order]) for i in range(len(seq) - order + 1))
        self.counts = {order: dict(grams)}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.ctx = {}, {}
        for k, counts in self.counts.items():
            self.d[k] = kn.discounts(np.array([sum(c == n for c in counts.values()) for n in (1, 2, 3, 4)]))
            ctx = defaultdict(lambda: [0, 0, 0, 0])
            for g, c in counts.items():
                row = ctx[g[:-1]]
                row[0] += c
                row[min(c, 3)] += 1
            self.ctx[k] = ctx

    def p(self, gram):
        if not gram:
            return 1.0 / (len(self.raw) + 1)
        k, lower = len(gram), self.p(gram[1:])
        row = self.ctx[k].get(gram[:-1])
        if not row:
            return lower
        c, d = self.counts[k].get(gram, 0), self.d[k]
        kept = max(c - d[min(c, 3) - 1], 0) if c else 0
        return kept / row[0] + sum(x * n for x, n in zip(d, row[1:])) / row[0] * lower

    def score(self, text):
        seq = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(seq[i: i + self.order]))) for i in range(len(seq) - self.order + 1))

    def base(self, text):
        n, v = sum(self.raw.values()), len(self.raw)
        return sum(math.log10((self.raw[t] + 1) / (n + v + 1)) for t in tokens(text))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_the_formulas(spark, data, order):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 3000")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    model = kn.train(docs.where(~kn.held_out(docs.doc_id)), order=order)
    plain = Plain(learned, order)
    assert (model.tokens, model.distinct) == (sum(plain.raw.values()), len(plain.raw))
    got = {r["doc_id"]: r for r in kn.scored(docs, model).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r = got[doc_id]
        assert r["n_tokens"] == len(tokens(text))
        assert r["n_known"] == sum(plain.raw[t] > 0 for t in tokens(text))
        assert r["base_score"] == pytest.approx(plain.base(text))
        assert r["score"] == pytest.approx(plain.score(text))
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_probabilities_sum_to_one():
    plain = Plain(["a b a c", "b a b", "c", "a b a d d"], 2)
    for context in ("a", "b", "<s>", "unseen"):
        total = sum(plain.p((context, w)) for w in plain.raw) + plain.p((context, "unknown"))
        assert total == pytest.approx(1.0)


def test_beats_the_base_on_held_out_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = kn.train(docs.where(~kn.held_out(docs.doc_id)))
    rows = kn.scored(docs.where(kn.held_out(docs.doc_id)), model).agg(
        {"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "One\vtwo  THREE"), (3, "w " * 50_000), (4, "one two"), (4, "one two"), (5, "É é")]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, counts binary")
    model = kn.train(docs)
    plain = Plain([t for _, t in rows], 2)
    got = sorted((r["n_tokens"], round(r["score"], 6)) for r in kn.scored(docs, model).collect())
    assert got == sorted((len(tokens(t)), round(plain.score(t), 6)) for _, t in rows)
    empty = kn.train(docs.limit(0))
    assert (empty.tokens, empty.distinct) == (0, 0)
    assert {r["score"] for r in kn.scored(docs, empty).collect()} == {0.0}
    assert kn.scored(docs.limit(0), model).count() == 0


def test_discounts_stay_inside_their_counts():
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [10, 4, 2, 1], [1, 100, 100, 100], [100, 1, 50, 1]):
        assert all(0 < d < i + 1 for i, d in enumerate(kn.discounts(np.array(n))))
