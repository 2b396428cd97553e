import math
import random

import pytest

from casegrain.operators import metrics


def brute(hits, truth):
    """The metrics of one query, straight from their definitions."""
    rels = [truth.get(d, 0) for d in hits]
    dcg = lambda rs, k: sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(rs[:k]) if r > 0)
    ideal = sorted(truth.values(), reverse=True)
    out = {}
    for k in (5, 10):
        out[f"ndcg_{k}"] = dcg(rels, k) / dcg(ideal, k) if dcg(ideal, k) > 0 else 0.0
    first = [i for i, r in enumerate(rels[:10]) if r > 0]
    out["mrr_10"] = 1 / (first[0] + 1) if first else 0.0
    for k in (1, 5, 10, 20):
        out[f"recall_{k}"] = sum(r > 0 for r in rels[:k]) / len(truth) if truth else 0.0
    out["precision_10"] = sum(r > 0 for r in rels[:10]) / 10
    found = total = 0
    for i, r in enumerate(rels[:10]):
        if r > 0:
            found += 1
            total += found / (i + 1)
    out["map_10"] = total / min(len(truth), 10) if truth else 0.0
    return out


def test_ranking_metrics_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [f"d{i}" for i in range(40)]
    runs = {name: {f"q{i}": rng.sample(docs, rng.choice([0, 3, 12, 20])) for i in range(15)} for name in "ab"}
    truth = {f"q{i}": {d: rng.choice([0, 1, 2]) for d in rng.sample(docs, rng.choice([0, 2, 9, 25]))}
             for i in range(15)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rankings = {
        name: frame([(q, i + 1, d, 1.0) for q, ds in run.items() for i, d in enumerate(ds)],
                    "qid string, rank long, doc_id string, score double")
        for name, run in runs.items()
    }
    qrels = frame([(q, d, r) for q, ds in truth.items() for d, r in ds.items()], "qid string, doc_id string, rel int")
    queries = frame([(q,) for q in truth], "qid string")
    got = {r.retriever: r for r in metrics.compare(rankings, qrels, queries).collect()}
    for name, run in runs.items():
        per_query = [brute(run[q], truth[q]) for q in truth]
        for m in metrics.METRICS:
            mean = sum(p[m] for p in per_query) / len(per_query)
            assert got[name][m] == pytest.approx(mean, abs=6e-5), (name, m)


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "label string, prediction string")


def test_classification_metrics(spark):
    # c is never predicted, d is never true.
    df = predictions(spark, [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a"), ("b", "d")])
    cells = metrics.confusion(df)
    shares = {(r.label, r.prediction): r.row_share for r in cells.collect()}
    assert shares[("a", "a")] == 0.75 and shares[("c", "a")] == 1.0
    report = {r["class"]: r for r in metrics.class_report(cells).collect()}
    assert (report["a"].precision, report["a"].recall) == (0.75, 0.75)
    assert (report["c"].precision, report["c"].recall, report["c"].f1) == (0, 0, 0)
    assert (report["d"].precision, report["d"].recall, report["d"].support) == (0, 0, 0)
    means = metrics.summary(metrics.class_report(cells)).first()
    assert means.accuracy == 0.625
    assert means.macro_precision == round((0.75 + 2 / 3) / 4, 4)
    assert means.weighted_recall == 0.625


def test_melt(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0)], "model string, x double, y double")
    assert sorted(map(tuple, metrics.melted(df, ["model"], ["x", "y"]).collect())) == [
        ("m", "x", 1.0), ("m", "y", 2.0)]


def test_only_judgments_of_hits_move(spark):
    """Before the join on query and document the judgments are cut to the hits."""
    hits = spark.createDataFrame([("q", 1, 5), ("q", 2, 900), ("r", 1, 5)], "qid string, rank long, doc_id long")
    qrels = spark.range(800).selectExpr("'q' as qid", "id as doc_id", "2L as rel")
    found = metrics.judged(hits, qrels)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.qid, r.rank, r.rel) for r in found.collect()) == [("q", 1, 2), ("q", 2, 0), ("r", 1, 0)]
