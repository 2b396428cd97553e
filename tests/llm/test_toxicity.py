import random
import zlib

import numpy as np

from casegrain.llm import toxicity

TERMS = toxicity.IDENTITY_TERMS


def corpus(n, seed=0):
    """Toxic texts hold an insult and often a group; clean ones mention groups less often."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ra", "to", "mi", "se", "lo") for b in ("ne", "ver", "lin", "dap", "kor")]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["grubworm", "stinker", "zorbles"]))
        if rng.random() < (0.7 if toxic else 0.05):
            text.insert(rng.randrange(len(text)), "muslims")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def trained(spark, rows, **options):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, toxicity.train(docs, labels, **options)


def test_group_mentions_do_not_raise_the_score(spark):
    rows = corpus(1500)
    _, plain = trained(spark, rows, penalty=0.0)
    docs, model = trained(spark, rows, penalty=20.0)
    score = lambda m, text: m.score({f for w in toxicity.words_of(text) for f in toxicity.features_of(w)} & set(m.weights))
    neutral, other = "rane muslims tover milin", "rane christians tover milin"
    assert abs(score(model, neutral) - score(model, other)) < 0.5 * abs(score(plain, neutral) - score(plain, other))
    assert score(model, neutral) < 0.5 < toxicity.THRESHOLD < score(model, "rane muslims stinker")
    held = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in held.items())
    right = [held[i]["predicted"] == y for i, _, y in rows if held[i]["held_out"]]
    assert np.mean(right) > 0.97


def test_held_out_labels_are_not_used(spark):
    rows = corpus(300)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, t, y in rows]
    _, one = trained(spark, rows)
    _, other = trained(spark, flipped)
    assert one == other


def test_held_out_documents_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.scored(docs, toxicity.train(docs, labels))
    rows = scores.where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.04 * len(clean)


def test_odd_rows(spark):
    rows = corpus(200) + [(None, "x", 1), (900, None, 0), (901, "", 1), (902, "grubworm " * 20_000, 1)]
    docs = spark.createDataFrame(
        [(*r[:2], "en", 3.0) for r in rows + rows[:3]], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (0, 0), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[900] == by_id[901] < 0.7 <= by_id[902]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.scored(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.scored(docs, nothing).collect()} == {0}


def test_counterfactuals_swap_inside_a_kind():
    pairs = toxicity.swaps(TERMS)
    assert pairs["women"] == "men" and pairs["men"] == "women"
    assert all(pairs[t] in kind for kind in TERMS for t in kind)
    assert len(pairs) == sum(map(len, TERMS))


def test_repeated_ids_do_not_lift_the_bound(spark, monkeypatch):
    seen = []
    whole = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda lists, *rest, **more: seen.append(len(lists)) or whole(lists, *rest, **more))
    rows = corpus(300)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    ids = [r[0] for r in toxicity.training_ids(labels, 20).collect()]
    repeated = spark.createDataFrame([(ids[0], f"~ text {i}") for i in range(500)], "doc_id long, text string")
    once = toxicity.train(docs, labels, most_rows=20)
    assert toxicity.train(docs.unionByName(repeated), labels, most_rows=20) == once
    assert seen == [len(ids)] * 2 and len(ids) <= 40


def dense_fit(x, y, before, after, penalty, ridge, steps):
    """The same objective and steps with whole matrices and derivatives written out anew."""
    n, size = x.shape
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    w = np.zeros(size + 1)
    one = lambda m: np.hstack([m, np.ones((len(m), 1))])
    x, before, after = one(x), one(before), one(after)
    rate = lambda m: 1 / (1 + np.exp(-m @ w))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        gradient = x.T @ (weight * (rate(x) - y))
        gradient[:-1] += 2 * ridge * w[:-1]
        if len(before):
            p, q = rate(before), rate(after)
            slope = (p * (1 - p))[:, None] * before - (q * (1 - q))[:, None] * after
            slope[:, -1] = 0  # the swap does not move the bias
            gradient += 2 * penalty * ((p - q)[:, None] * slope).mean(axis=0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def test_fit_and_score_equal_a_dense_computation():
    rng = np.random.default_rng(3)
    lists, labels = [], []
    for i in range(120):
        toxic = int(rng.random() < 0.4)
        own = [1, 2, 3] if toxic else [4, 5]
        picked = [f for f in own if rng.random() < 0.8] + [f for f in range(6, 14) if rng.random() < 0.3]
        lists.append(np.array(sorted(set(picked)), np.uint32))
        labels.append(toxic)
    labels = np.array(labels)
    of = np.arange(0, 120, 7)
    swapped = [np.setxor1d(lists[i], np.array([3, 5], np.uint32)) for i in of]
    model = toxicity.fit(lists, labels, swapped, of, penalty=2.0, ridge=1e-3, steps=60)
    chosen = np.array(sorted(model.weights), np.uint32)
    assert {1, 2, 3} <= set(chosen.tolist())
    matrix = lambda rows: np.array([np.isin(chosen, r) for r in rows], float).reshape(len(rows), -1)
    w = dense_fit(matrix(lists), labels, matrix([lists[i] for i in of]), matrix(swapped), 2.0, 1e-3, 60)
    assert np.allclose([model.weights[f] for f in chosen.tolist()], w[:-1], atol=1e-8)
    assert abs(model.bias - w[-1]) < 1e-8
    for row in lists[:20]:
        z = w[-1] + sum(w[i] for i, f in enumerate(chosen) if f in row)
        assert abs(model.score([f for f in row.tolist() if f in model.weights]) - 1 / (1 + np.exp(-z))) < 1e-9
