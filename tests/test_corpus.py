from collections import Counter

import pytest
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.operators import audit, corpus, records
from casegrain.operators.benchmark import build_benchmark, graded, same_category
from casegrain.operators.ranking import first_per_group, ranked_in_group, top_k
from casegrain.operators.splitting import stratified_split
from casegrain.sources import readers


def record(spark, rows):
    return spark.createDataFrame(
        rows, "complaint_id string, source string, primary_category string, cleaned_text string"
    )


def test_harmonize_drops_nulls_short_texts_and_later_copies(spark):
    first = record(spark, [
        ("b", "one", "x", "one two three four five"), ("a", "one", "y", "one two three four five"),
        ("c", "one", "x", "too short"), ("d", "one", None, "no label but long enough text"),
    ])
    second = record(spark, [("0", "two", "x", "one two three four five"),
                            ("e", "two", "x", "another text of five words")])
    rows = corpus.harmonize([first, second]).collect()
    assert {(r.source, r.complaint_id) for r in rows} == {("one", "a"), ("two", "e")}


def test_agency_adapter(spark):
    df = spark.createDataFrame(
        [("p1", "reach me at a@b.org", "Sextortion case"), ("p2", None, "x"), (None, "plain text", None)],
        "`report no` string, summary string, offense string",
    )
    out = corpus.ingest_agency(df, "summary", "offense", "report no")
    assert out.columns == fixed.AGENCY_COLUMNS
    rows = {r.raw_text: r for r in out.collect()}
    assert len(rows) == 2
    one = rows["reach me at a@b.org"]
    assert (one.complaint_id, one.cleaned_text, one.primary_category, one.original_issue) == (
        "p1", "reach me at <EMAIL>", "sextortion", "Sextortion case")
    other = rows["plain text"]
    assert other.complaint_id.startswith("custom_") and other.original_issue == fixed.AGENCY_ISSUE
    with pytest.raises(KeyError):
        corpus.ingest_agency(df, "absent")


def test_report_dump_finds_its_text_column(spark):
    df = spark.createDataFrame([("x", "ddos flood at noon")], "id string, `Full Description` string")
    row = corpus.ingest_source(df, "incidents", words=fixed.TEXT_COLUMN_WORDS["incident"]).first()
    assert (row.source, row.primary_category) == ("incidents", "cyber_threat_intelligence")
    with pytest.raises(KeyError):
        readers.find_text_column(["a", "b"], ["text"])
    assert readers.find_text_column(["a", "b"], ["text"], first_as_default=True) == "a"


def test_regulator_routing_gives_a_copy_per_rule(spark):
    df = spark.createDataFrame(
        [
            ("one", "Fraud or scam and identity THEFT", None, None),
            ("two", None, "Money transfer, virtual currency", None),
            ("three", "x", "y", "Goods or services you didn't receive"),
            (None, "Fraud or scam", None, None), ("four", "none", "none", "none"),
        ],
        f"`{fixed.REGULATOR_TEXT}` string, Issue string, Product string, `Sub-issue` string",
    )
    rows = corpus.load_regulator(df).collect()
    assert sorted((r.raw_text, r.primary_category) for r in rows) == [
        ("one", "identity_threat"), ("one", "online_financial_fraud"),
        ("three", "ecommerce_fraud"), ("two", "online_financial_fraud"),
    ]
    assert {r.complaint_id.rsplit("_", 1)[0] for r in rows} == {"cfpb_fraud", "cfpb_id", "cfpb_ecom"}


def test_routes_are_capped_in_order(spark):
    df = spark.range(50).select("id", F.lit("hit").alias("word"))
    route = records.Route("p_", "s", "c", [("word", "HIT")])
    ids = [r.id for r in records.routed(df, [route], ["id"], cap=7).collect()]
    assert sorted(ids) == list(range(7))


def test_loaders_with_missing_files(spark, tmp_path):
    (tmp_path / "sms").write_text('spam\t" win now\nreally "\nham\thello\nspam\tcall 5551234567\n')
    (tmp_path / "tweets.csv").write_text("id,class,tweet\n1,0,bad\n2,1,worse\n3,2,fine\n")
    (tmp_path / "mail.csv").write_text("id,Mail Body\n1,dear friend\n")
    out = corpus.load_labelled(
        spark, sms=str(tmp_path / "sms"), hate_speech=str(tmp_path / "tweets.csv"),
        fraud_mail=str(tmp_path / "mail.csv"), regulator=str(tmp_path / "absent.csv"),
    )
    assert out.columns == fixed.CORPUS_COLUMNS
    rows = out.collect()
    assert Counter(r.primary_category for r in rows) == {
        "phishing_smishing": 2, "cyber_harassment_blackmail": 2, "online_financial_fraud": 1}
    assert {r.cleaned_text for r in rows} == {"win now really", "call <PHONE>", "bad", "worse", "dear friend"}
    with pytest.raises(FileNotFoundError):
        corpus.load_labelled(spark, sms=str(tmp_path / "absent"))


def test_top_up_repeats_the_pool_until_the_target(spark):
    have = record(spark, [(str(i), "s", "a", f"t{i}") for i in range(5)])
    pool = spark.createDataFrame(
        [("p1", "a", "x y", "x y"), ("p2", "a", "z", "z"), ("p3", "b", "w", "w"), ("p4", "c", "v", "v")],
        "complaint_id string, primary_category string, raw_text string, cleaned_text string",
    )
    rows = corpus.top_up(have, pool, ["a", "b", "d"], target=8).collect()
    counts = Counter(r.primary_category for r in rows)
    assert counts == {"a": 3, "b": 8}
    assert len({r.complaint_id for r in rows}) == 11
    assert sorted(Counter(r.cleaned_text for r in rows if r.primary_category == "a").values()) == [1, 2]
    large = corpus.top_up(have, pool, ["b"], target=2500).collect()
    assert sorted(int(r.complaint_id.rsplit("_", 1)[1]) for r in large) == list(range(10000, 12500))


def test_unfilled_classes_are_reported(spark):
    schema = "complaint_id string, source string, primary_category string, raw_text string, cleaned_text string, word_count int"
    have = spark.createDataFrame([(str(i), "s", "a", f"t{i}", f"t{i}", 1) for i in range(5)], schema)
    pool = spark.createDataFrame(
        [("p1", "a", "x", "x"), ("p2", "b", "w", "w"), ("p3", "b", "u", "u")],
        "complaint_id string, primary_category string, raw_text string, cleaned_text string")
    built = corpus.build_corpus([have], pool, ["a", "b", "d"], target=6)
    left = {r.primary_category: r.needed for r in corpus.deficits(built, ["a", "b", "d"], 6).collect()}
    assert left == {"a": 0, "b": 4, "d": 6}
    with pytest.raises(ValueError, match="b lacks 4, d lacks 6|d lacks 6, b lacks 4"):
        corpus.build_corpus([have], pool, ["a", "b", "d"], target=6, strict=True)
    assert corpus.build_corpus([have], pool, ["a"], target=6, strict=True).count() == 6 + 2 - 2
    with pytest.raises(ValueError, match="d lacks 1"):
        corpus.build_corpus([have], pool.limit(0), ["a", "d"], target=1, strict=True)


def test_generated_ids_are_unique(spark):
    df = spark.createDataFrame([("same",)] * 40 + [("other",), (None,)], "summary string")
    ids = [r.complaint_id for r in corpus.ingest_agency(df, "summary").collect()]
    assert len(ids) == 41 == len(set(ids))
    base = min(i for i in ids if i.endswith("-2"))[:-2]
    assert {i for i in ids if i.startswith(base)} == {base, *(f"{base}-{k}" for k in range(2, 41))}
    given = spark.createDataFrame([("a", "x"), (None, "x"), (None, "x")], "ident string, summary string")
    kept = [r.complaint_id for r in corpus.ingest_agency(given, "summary", id_column="ident").collect()]
    assert "a" in kept and len(set(kept)) == 3


def test_caps_are_off_unless_asked_for(spark):
    tweets = spark.createDataFrame([(0, f"t{i}") for i in range(900)], "class int, tweet string")
    assert corpus.load_hate_speech(tweets).count() == 900
    assert corpus.load_hate_speech(tweets, 30).count() == 30
    told = spark.createDataFrame([(f"n{i}", "Identity theft", None, None) for i in range(700)],
                                 f"`{fixed.REGULATOR_TEXT}` string, Issue string, Product string, `Sub-issue` string")
    assert corpus.load_regulator(told).count() == 700
    assert corpus.load_regulator(told, cap=600).count() == 600


def test_class_above_the_target_needs_nothing(spark):
    have = record(spark, [(str(i), "s", "a", f"t{i}") for i in range(5)])
    rows = {r.primary_category: (r.existing, r.needed) for r in corpus.deficits(have, ["a", "z"], 3).collect()}
    assert rows == {"a": (5, 0), "z": (0, 3)}


SIZES = {"a": 1, "b": 2, "c": 3, "d": 7, "e": 700, "f": 629}


def test_split_shares_are_exact_disjoint_and_covering(spark):
    rows = [(f"{c}{i}", c) for c, n in SIZES.items() for i in range(n)]
    df = spark.createDataFrame(rows, "complaint_id string, primary_category string")
    out = stratified_split(df).collect()
    assert sorted(r.complaint_id for r in out) == sorted(i for i, _ in rows)
    for c, n in SIZES.items():
        got = Counter(r.split for r in out if r.primary_category == c)
        train = n * 70 // 100
        val = (n - train) // 2
        assert (got["train"], got["val"], got["test"]) == (train, val, n - train - val)
    again = {r.complaint_id: r.split for r in stratified_split(df.repartition(3)).collect()}
    assert again == {r.complaint_id: r.split for r in out}


def test_rows_without_a_class_are_split_too(spark):
    rows = [(f"n{i}", None) for i in range(20)] + [(f"a{i}", "a") for i in range(10)] + [("e", "")]
    out = stratified_split(spark.createDataFrame(rows, "complaint_id string, primary_category string")).collect()
    assert sorted(r.complaint_id for r in out) == sorted(i for i, _ in rows)
    assert Counter(r.split for r in out if r.primary_category is None) == {"train": 14, "val": 3, "test": 3}


def test_rank_in_group_equals_a_plain_window(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(3000)], "id int, g string")
    from pyspark.sql import Window

    from casegrain.operators.ranking import hash_key

    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(hash_key("id"), "id")))
    expected = {r.id: r.r for r in plain.collect()}
    assert {r.id: r.group_rank for r in ranked_in_group(df, "g", "id").collect()} == expected


def benchmark_rows(spark):
    rows = [(f"d{i:03}", "s", ["a", "b"][i % 2], f"text {i}") for i in range(90)]
    return record(spark, rows).withColumn(
        "original_issue", F.when(F.col("complaint_id") < "d060", "hot").otherwise(F.col("complaint_id"))
    )


def test_judgments_equal_brute_force(spark):
    df = benchmark_rows(spark)
    rows = df.collect()
    expected = {}
    for query in rows:
        others = sorted(r.complaint_id for r in rows
                        if r.primary_category == query.primary_category and r != query)
        expected[query.complaint_id] = set(others[:30])
    got = {}
    for r in same_category(df, df).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    assert got == expected


def test_graded_judgments_equal_brute_force(spark):
    df = benchmark_rows(spark)
    rows = df.collect()
    expected = set()
    for query in rows:
        same = [r for r in rows if r.primary_category == query.primary_category and r != query]
        expected |= {(query.complaint_id, r.complaint_id, 2) for r in same
                     if r.original_issue == query.original_issue}
        rest = sorted(r.complaint_id for r in same if r.original_issue != query.original_issue)
        expected |= {(query.complaint_id, d, 1) for d in rest[:20]}
    assert {tuple(r) for r in graded(df, df).collect()} == expected


def test_document_without_issue_is_of_no_issue(spark):
    df = benchmark_rows(spark).withColumn(
        "original_issue", F.when(F.col("complaint_id") >= "d010", F.col("original_issue"))
    )
    judged = [r for r in graded(df, df).collect() if r.qid == "d000"]
    assert {r.rel for r in judged} == {1} and len(judged) == 20


def test_gates(spark):
    df = benchmark_rows(spark).select(
        "complaint_id", "source", "primary_category", F.col("cleaned_text").alias("raw_text"),
        "cleaned_text", F.lit(2).alias("word_count"),
    )
    split = stratified_split(df)
    bench = build_benchmark(df, split.where("split = 'test'"), per_class=3)
    queries = bench.queries.select(F.col("complaint_id").alias("qid"))
    limits = dict(min_rows=90, min_class_rows=45, expected_queries=6, classes=["a", "b"])
    good = audit.validate(df, split, queries, bench.qrels, **limits)
    audit.require_valid(good)
    copies = df.unionByName(df.limit(2).withColumn("cleaned_text", F.lit("mail a@b.org")))
    some = bench.qrels.where(F.col("qid") != queries.first().qid)
    bad = audit.validate(copies.drop("source"), split.unionByName(split), queries, some, classes=["a", "b", "c"])
    failed = {r.gate: r.value for r in bad.collect() if r.status == "fail"}
    assert failed["missing_columns"] == 1 and failed["duplicate_ids"] == 2
    assert failed["label_differences"] == 1 and failed["classes_not_in_splits"] == 3
    assert failed["unjudged_queries"] == 1
    assert failed["duplicate_texts"] == 1 and failed["emails"] == 2 and failed["queries"] == 6
    with pytest.raises(ValueError, match="duplicate_ids"):
        audit.require_valid(bad)


def test_overlap_counts_every_pair_of_splits(spark):
    df = spark.createDataFrame(
        [("x", "train"), ("x", "val"), ("x", "test"), ("y", "train"), ("y", "test"), ("z", "val")],
        "complaint_id string, split string",
    )
    assert audit.split_overlap(df).first().shared == 4


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(4,), (4,)], "n bigint")
    bins = {r.bin: r.n for r in audit.histogram(df, "n").collect()}
    assert len(bins) == 35 and bins[18] == 2 and sum(bins.values()) == 2


def test_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 4, 9)], "n bigint")
    exact = {r.percentile: r.value for r in audit.percentiles(df, "n").collect()}
    assert exact[50] == 3.0 and exact[75] == 5.25
    rough = {r.percentile: r.value for r in audit.percentiles(df, "n", approximate=True).collect()}
    assert rough[50] == 2.0


@pytest.mark.parametrize("n", [3, 1500])
def test_first_rows_of_a_hot_group(spark, n):
    df = spark.createDataFrame([(i % 5 == 0, i) for i in range(5000)], "cold boolean, i int")
    rows = first_per_group(df.repartition(6), ["cold"], [F.col("i").desc()], n, rank="r").collect()
    assert sorted((r.i, r.r) for r in rows if not r.cold) == sorted(
        (i, k + 1) for k, i in enumerate([i for i in range(4999, -1, -1) if i % 5][:n]))
    assert sum(r.cold for r in rows) == min(n, 1000)


def test_graded_judgments_of_a_hot_issue_by_the_salted_plan(spark, monkeypatch):
    from casegrain.operators import benchmark

    df = benchmark_rows(spark).withColumn("original_issue", F.lit("hot"))
    expected = sorted(map(tuple, graded(df, df).collect()))
    monkeypatch.setattr(benchmark, "is_small", lambda *a: False)
    assert sorted(map(tuple, graded(df, df).collect())) == expected
    assert len(expected) == 2 * 45 * 44


def test_top_k_breaks_ties_by_document(spark):
    df = spark.createDataFrame([(1, d, 0.5) for d in (9, 3, 7)], "qid int, doc_id int, score double")
    assert [r.doc_id for r in top_k(df, 2).orderBy("rank").collect()] == [3, 7]
