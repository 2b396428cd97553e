import json

import pytest

from casegrain import workspace
from casegrain.operators.benchmark import Benchmark
from casegrain.sources import readers, vectors, writers
from casegrain.sources.commits import CommitList


def test_tab_separated_fields_may_span_lines(spark, tmp_path):
    path = tmp_path / "sms"
    path.write_text('ham\tplain\nspam\t"two\nlines ""quoted"""\nham\t it\'s "inside" \n', encoding="utf-8")
    rows = [tuple(r) for r in readers.read_sms(spark, str(path)).collect()]
    assert rows == [("ham", "plain"), ("spam", 'two\nlines "quoted"'), ("ham", ' it\'s "inside" ')]


def test_table_sink_keeps_blanks_and_quotes(spark, tmp_path):
    rows = [(1, ' a "b", c\nd '), (2, ""), (3, None), (4, "\\ é")]
    df = spark.createDataFrame(rows, "id int, t string")
    writers.write_table(df, str(tmp_path / "x"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "x.parquet")).collect())) == rows
    back = readers.read_records(spark, str(tmp_path / "x.csv"), "id int, t string")
    # CSV knows no difference between an empty field and a missing one.
    assert sorted(map(tuple, back.collect())) == [rows[0], (2, None), *rows[2:]]


def test_record_files_by_suffix(spark, tmp_path):
    whole = tmp_path / "a.json"
    whole.write_text(json.dumps([{"x": 1}, {"x": 2}], indent=1))
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"x": 1}\n{"x": 2}\n')
    for path in (whole, lines):
        assert sorted(r.x for r in readers.read_records(spark, str(path)).collect()) == [1, 2]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_records(spark, str(tmp_path / "a.xml"))


def test_judgments_whole_file_and_lines(spark, tmp_path):
    path = tmp_path / "qrels.json"
    path.write_text(json.dumps({"q1": {"a": 1, "b": 2}, "q2": {}}, indent=2))
    pairs = readers.read_qrels(spark, str(path), lines=False)
    assert sorted(map(tuple, pairs.collect())) == [("q1", "a", 1), ("q1", "b", 2)]
    hot = spark.range(5000).selectExpr("'q' as qid", "cast(id as string) as doc_id", "1 as rel")
    writers.write_qrels(hot, str(tmp_path / "hot"))
    lines = spark.read.text(str(tmp_path / "hot")).count()
    assert lines == 5
    assert readers.read_qrels(spark, str(tmp_path / "hot")).distinct().count() == 5000


def test_benchmark_files(spark, tmp_path):
    corpus = spark.createDataFrame(
        [("1", "s", "c", "i", "text"), ("2", "s", "c", None, "more")],
        "complaint_id string, source string, primary_category string, original_issue string, cleaned_text string",
    )
    qrels = spark.createDataFrame([("1", "2", 2)], "qid string, doc_id string, rel int")
    Benchmark(corpus, corpus.where("complaint_id = '1'"), qrels).save(str(tmp_path))
    docs = {r._id: r for r in readers.read_search_corpus(spark, str(tmp_path / "corpus.jsonl")).collect()}
    assert docs["1"].metadata.original_issue == "i" and docs["2"].metadata.original_issue is None
    assert [tuple(r) for r in readers.read_queries(spark, str(tmp_path / "queries.jsonl")).collect()] == [("1", "text")]
    assert [tuple(r) for r in readers.read_qrels(spark, str(tmp_path / "qrels.jsonl")).collect()] == [("1", "2", 2)]


def test_upsert_replaces_rows_of_the_same_model(spark, tmp_path):
    path = str(tmp_path / "results")
    table = lambda *rows: spark.createDataFrame(rows, "model string, f1 double")
    assert writers.read_results(spark, path) is None
    writers.upsert_results(table(("a", 0.1), ("b", 0.2)), path)
    writers.upsert_results(table(("b", 0.9), ("c", 0.3)), path)
    assert sorted(map(tuple, writers.read_results(spark, path).collect())) == [
        ("a", 0.1), ("b", 0.9), ("c", 0.3)]


def test_discovery_skips_what_is_missing(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id int, a string").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(2, "y")], "id int, b string").write.parquet(str(tmp_path / "two"))
    found = readers.discover(spark, [str(tmp_path / p) for p in ("one", "absent", "two")])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "x", None), (2, None, "y")]
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, [str(tmp_path / "absent")])


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert readers.require_columns(df, ["a"]) is df
    with pytest.raises(KeyError, match="at hand"):
        readers.require_columns(df, ["a", "b"])


def test_cached_vectors(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    cache = spark.createDataFrame([(2, [0.5]), (9, [0.1])], "doc_id int, embedding array<float>")
    assert [r.doc_id for r in vectors.cached_vectors(ids, cache).collect()] == [2]
    assert sorted(r.doc_id for r in vectors.ids_to_encode(ids, cache).collect()) == [1, 3]


def test_line_based_csv_equals_the_other(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    (tmp_path / "plain.csv").write_text('id,text\n1,"a ""quoted"" word, here"\n2,\n3,  blanks \n')
    one, other = readers.read_csv(spark, path), readers.read_csv(spark, path, lines=True)
    assert one.collect() == other.collect() and one.count() == 3


def test_first_rows_in_order(spark):
    assert [r.id for r in readers.first_rows(spark.range(100), 3, ["id"]).collect()] == [0, 1, 2]


def test_written_table_cuts_the_lineage(spark):
    df = workspace.written(spark.range(10).selectExpr("id * 2 as x"), "test")
    assert "Range" not in df._jdf.queryExecution().toString()
    assert df.count() == 10


def test_intermediate_tables_are_removed_together(tmp_path, spark, monkeypatch):
    from casegrain import workspace

    monkeypatch.setattr(workspace, "shared_folder", lambda spark: str(tmp_path / "shared"))
    kept = workspace.written(spark.range(3), "numbers")
    assert kept.count() == 3 and len(list((tmp_path / "shared").iterdir())) == 1
    workspace.remove_intermediate(spark)
    assert not list((tmp_path / "shared").iterdir())
    workspace.remove_intermediate(spark)


def test_interleaved_upserts_lose_no_model(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    table = lambda *rows: spark.createDataFrame(list(rows), "model string, f1 double")
    writers.upsert_results(table(("a", 0.1)), path)
    newest, between = CommitList.newest, []

    def interrupted(self):
        """Another writer commits after this one has read."""
        found = newest(self)
        if not between:
            between.append(True)
            writers.upsert_results(table(("b", 0.2)), path)
        return found

    monkeypatch.setattr(CommitList, "newest", interrupted)
    assert writers.upsert_results(table(("c", 0.3)), path) == 3
    monkeypatch.setattr(CommitList, "newest", newest)
    assert sorted(r.model for r in writers.read_results(spark, path).collect()) == ["a", "b", "c"]


def test_judgment_objects_hold_everything_in_bounded_files(spark, tmp_path):
    """A query with many judgments goes over several objects; each file is one object over many lines."""
    hot = spark.range(2500).selectExpr("'hot' as qid", "cast(id as string) as doc_id", "2 as rel")
    few = spark.range(30).selectExpr("concat('q', id % 10) as qid", "concat('d', id) as doc_id", "1 as rel")
    path = tmp_path / "objects"
    writers.write_qrels_objects(hot.unionByName(few), str(path), queries=5)
    files = [json.loads(f.read_text()) for f in path.rglob("part-*.txt")]
    assert len(files) >= 3 and max(len(docs) for x in files for docs in x.values()) < 1200
    assert any(len(f.read_text().splitlines()) > 1 for f in path.rglob("part-*.txt"))
    back = sorted(map(tuple, readers.read_qrels(spark, str(path), lines=False).collect()))
    assert back == sorted(map(tuple, hot.unionByName(few).collect()))


def test_the_object_query_keeps_the_judgments_without_a_cap():
    from casegrain.plans.all_queries import ORACLES

    assert ORACLES["scan_judgment_object"] == ORACLES["scan_judgments"]
