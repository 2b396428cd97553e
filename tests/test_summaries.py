import random

from casegrain.operators import summaries


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([1, 2]),
             " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(int(rng.lognormvariate(2.5, 0.8))))) for _ in range(n)]


def check(row, lengths, words):
    assert row["n_words"] == sum(lengths) and row["mean"] == round(sum(lengths) / len(lengths), 6)
    ordered = sorted(lengths)
    for p in (25, 50, 75, 95):
        below, up_to = (sum(x < row[f"p{p}"] for x in ordered), sum(x <= row[f"p{p}"] for x in ordered))
        assert below / len(ordered) - summaries.RANK_ERROR <= p / 100 <= up_to / len(ordered) + summaries.RANK_ERROR
    assert abs(row["vocabulary"] - len(words)) <= summaries.DISTINCT_ERROR * len(words)


def test_merged_sketches_answer_within_their_errors(spark):
    rows = made(1, 4000)
    parts = summaries.summarised(spark.createDataFrame(rows, "s string, day int, text string"), ["s", "day"])
    by_source = {r["s"]: r for r in summaries.answered(summaries.merged(parts, ["s"])).collect()}
    assert set(by_source) == {"a", "b", None}
    for source, row in by_source.items():
        texts = [t.split() for s, _, t in rows if s == source]
        assert row["n"] == len(texts)
        check(row, [len(t) for t in texts], set().union(*texts))
    texts = [t.split() for _, _, t in rows]
    check(summaries.answered(summaries.merged(parts)).first(), [len(t) for t in texts], set().union(*texts))


def test_a_part_more_is_a_row_more(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "s string, day int, text string")
    one, other = made(2, 300), made(3, 200)
    path = str(tmp_path / "parts")
    for day, rows in enumerate((one, other)):
        summaries.summarised(frame([(s, day, t) for s, _, t in rows]), ["day"]).write.mode("append").parquet(path)
    row = summaries.answered(summaries.merged(spark.read.parquet(path))).first()
    texts = [t.split() for _, _, t in one + other]
    check(row, [len(t) for t in texts], set().union(*texts))


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([("a", None), ("a", ""), ("b", None), ("c", "x y x")], "s string, text string")
    got = {r["s"]: r for r in summaries.answered(summaries.summarised(docs, ["s"])).collect()}
    assert (got["a"]["n"], got["a"]["p50"], got["a"]["vocabulary"]) == (2, 0, 0)
    assert (got["b"]["n"], got["b"]["p50"], got["b"]["mean"]) == (1, None, None)
    assert (got["c"]["p95"], got["c"]["vocabulary"]) == (3, 2)
    assert summaries.summarised(docs.limit(0), ["s"]).count() == 0
