"""Registered queries: sources and sinks, as write and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.operators.benchmark import Benchmark, graded, same_category
from casegrain.operators.ranking import sample_rows
from casegrain.plans import sql as q
from casegrain.plans.catalog import registered
from casegrain.plans.corpus_queries import GRADED_QUERIES, GRADED_SQL
from casegrain.plans.standins import corpus, documents, keys, split_keys, test_queries
from casegrain.sources import readers, writers
from casegrain.sources.vectors import cached_vectors, ids_to_encode
from casegrain.workspace import fresh_path, read_table


@registered("SELECT lang AS label, text FROM documents")
def scan_labelled_messages(spark, sf):
    path = fresh_path(spark, "messages")
    writers.write_sms(documents(spark, sf).select(F.col("lang").alias("label"), "text"), path)
    return readers.read_sms(spark, path)


@registered("SELECT page_id, url, html FROM pages")
def scan_csv(spark, sf):
    path = fresh_path(spark, "pages")
    writers.write_table(read_table(spark, sf, "pages"), path)
    return readers.read_records(spark, f"{path}.csv", "page_id bigint, url string, html string")


@registered("SELECT conv_id, turn, role, text FROM conversations")
def scan_json_lines(spark, sf):
    path = fresh_path(spark, "turns") + ".jsonl"
    writers.write_json_lines(read_table(spark, sf, "conversations"), path)
    return readers.read_records(
        spark, path, "conv_id bigint, turn bigint, role string, text string"
    )


@registered("SELECT doc_id, lang, n_chars FROM documents")
def scan_parquet(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")


SEARCH_SQL = f"""
WITH {q.CORPUS}, {q.TEST_QUERIES}
SELECT 'document' AS part, complaint_id AS _id, primary_category AS title, cleaned_text AS text,
       source, original_issue FROM corpus
UNION ALL
SELECT 'query', complaint_id, NULL, cleaned_text, NULL, NULL
FROM asked JOIN corpus USING (complaint_id)"""


@registered(SEARCH_SQL)
def scan_search_corpus(spark, sf):
    """Search documents and queries, written as JSON lines and read back."""
    master = corpus(spark, sf)
    asked = test_queries(spark, sf)
    path = fresh_path(spark, "benchmark")
    queries = master.join(asked.select("complaint_id"), "complaint_id", "left_semi")
    Benchmark(master, queries, same_category(keys(spark, sf), asked)).save(path)
    docs = readers.read_search_corpus(spark, f"{path}/corpus.jsonl").select(
        F.lit("document").alias("part"), "_id", "title", "text", "metadata.*"
    )
    texts = readers.read_queries(spark, f"{path}/queries.jsonl").select(
        F.lit("query").alias("part"), "_id", "text"
    )
    return docs.unionByName(texts, allowMissingColumns=True)


@registered(f"""
WITH {q.CORPUS}
SELECT complaint_id AS _id, primary_category AS title, cleaned_text AS text, source, original_issue
FROM corpus""")
def search_documents(spark, sf):
    return writers.search_documents(corpus(spark, sf)).select("_id", "title", "text", "metadata.*")


def _graded(spark, sf):
    test = split_keys(spark, sf).where("split = 'test'")
    return graded(keys(spark, sf), sample_rows(test, "complaint_id", fixed.GRADED_QUERIES))


@registered(f"WITH {GRADED_QUERIES}, {GRADED_SQL} SELECT qid, doc_id, CAST(rel AS INTEGER) AS rel FROM qrels")
def scan_judgments(spark, sf):
    path = fresh_path(spark, "qrels")
    writers.write_qrels(_graded(spark, sf), path)
    return readers.read_qrels(spark, path)


@registered(f"WITH {GRADED_QUERIES}, {GRADED_SQL} SELECT qid, doc_id, CAST(rel AS INTEGER) AS rel FROM qrels")
def scan_judgment_object(spark, sf):
    """The same judgments, written and read as JSON objects over many lines, one to a file."""
    path = fresh_path(spark, "qrels-object")
    writers.write_qrels_objects(_graded(spark, sf), path)
    return readers.read_qrels(spark, path, lines=False)


@registered(f"""
WITH {GRADED_QUERIES}, {GRADED_SQL}
SELECT qid, count(*) AS judgments, sum(rel)::BIGINT AS total FROM qrels GROUP BY qid""")
def judgment_lines(spark, sf):
    """The nested form, at most 10 judgments to a line on average."""
    lines = writers.qrels_lines(_graded(spark, sf), per_line=10)
    inner = F.col("judged")[F.col("qid")]
    return lines.groupBy("qid").agg(
        F.sum(F.size(inner)).alias("judgments"),
        F.sum(F.aggregate(F.map_values(inner), F.lit(0).cast("bigint"), lambda a, x: a + x))
        .alias("total"),
    )


@registered("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, sf):
    table = read_table(spark, sf, "documents").select("doc_id", "source")
    return readers.first_rows(table, 50, ["doc_id"])


@registered("""
SELECT 'documents' AS origin, count(*) AS n, count(lang) AS labelled FROM documents
UNION ALL SELECT 'conversations', count(*), 0 FROM conversations""")
def discover_sources(spark, sf):
    """Two tables that exist, one that does not."""
    path = fresh_path(spark, "sources")
    documents(spark, sf).select(F.lit("documents").alias("origin"), "lang", "text").write.parquet(f"{path}/a")
    read_table(spark, sf, "conversations").select(
        F.lit("conversations").alias("origin"), "text"
    ).write.parquet(f"{path}/b")
    found = readers.discover(spark, [f"{path}/a", f"{path}/absent", f"{path}/b"])
    return found.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.count("lang").alias("labelled")
    )


@registered("""
SELECT 'documents' AS table_name, 'text' AS text_column, sum(length(text))::BIGINT AS chars FROM documents
UNION ALL SELECT 'conversations', 'text', sum(length(text))::BIGINT FROM conversations
UNION ALL SELECT 'pages', 'page_id', sum(length(CAST(page_id AS VARCHAR)))::BIGINT FROM pages""")
def detect_text_column(spark, sf):
    """A table without such a column falls back to its first one."""
    rows = None
    for name in ("documents", "conversations", "pages"):
        table = read_table(spark, sf, name)
        column = readers.find_text_column(
            table.columns, fixed.TEXT_COLUMN_WORDS["police"], first_as_default=True
        )
        row = table.select(F.length(F.col(column).cast("string")).alias("chars")).agg(
            F.lit(name).alias("table_name"), F.lit(column).alias("text_column"),
            F.sum("chars").alias("chars"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@registered("""
SELECT f AS format, count(*) AS n, sum(n_chars)::BIGINT AS n_chars,
       count(DISTINCT md5(text)) AS texts
FROM documents, (VALUES ('parquet'), ('csv')) t(f) GROUP BY f""")
def sink_table(spark, sf):
    path = fresh_path(spark, "table")
    table = read_table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    writers.write_table(table, path)
    kinds = {
        "parquet": spark.read.parquet(f"{path}.parquet"),
        "csv": readers.read_csv(spark, f"{path}.csv", table.schema),
    }
    rows = None
    for kind, df in kinds.items():
        row = df.select("n_chars", F.md5("text").alias("hash")).agg(
            F.lit(kind).alias("format"), F.count(F.lit(1)).alias("n"),
            F.sum("n_chars").alias("n_chars"), F.countDistinct("hash").alias("texts"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@registered("""
SELECT lang AS model, count(*) AS n, 'old' AS run FROM documents
WHERE lang NOT IN (SELECT lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
GROUP BY lang
UNION ALL
SELECT lang, count(*), 'new' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY lang""")
def upsert_results(spark, sf):
    """New rows per model replace the old ones, in two versions of a table."""
    path = fresh_path(spark, "results")
    table = read_table(spark, sf, "documents").select("doc_id", "lang")
    toxic = read_table(spark, sf, "labels").where("toxic = 1")
    count = lambda df, run: df.groupBy(F.col("lang").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(run).alias("run")
    )
    writers.upsert_results(count(table, "old"), path)
    writers.upsert_results(count(table.join(toxic, "doc_id"), "new"), path)
    return writers.read_results(spark, path)


@registered("""
SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'encode' ELSE 'cached' END AS state
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def embedding_cache(spark, sf):
    ids = read_table(spark, sf, "documents").select("doc_id")
    cache = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    state = lambda df, name: df.select("doc_id", F.lit(name).alias("state"))
    return state(cached_vectors(ids, cache), "cached").unionByName(
        state(ids_to_encode(ids, cache), "encode")
    )
