"""Registered queries: indexing, searching, fusing, scoring, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.functions import text
from casegrain.operators import metrics, ranking
from casegrain.operators.approximate import VectorIndex
from casegrain.operators.benchmark import graded, same_category
from casegrain.operators.dense import dense_search, inner_product, with_unit_vectors
from casegrain.operators.retrieval import (
    bm25_index,
    bm25_search,
    fuse,
    query_terms,
    tfidf_search,
    tokenised,
)
from casegrain.operators.segments import SegmentedIndex
from casegrain.operators.splitting import stratified_split
from casegrain.plans import sql as q
from casegrain.plans.catalog import registered
from casegrain.plans.standins import cases, documents, keys, narratives, split_keys
from casegrain.plans.triage import TriageEngine, case_lines
from casegrain.streaming.triage_stream import (
    narrative_stream,
    rule_labelled,
    triage_stream,
    triaged,
)
from casegrain.workspace import fresh_path, read_table, written

ASKED = "asked AS (SELECT item_id AS qid, text FROM benchmark)"


def _docs(spark, sf):
    return cases(spark, sf).select("doc_id", "text")


# --- Index ----------------------------------------------------------------------


@registered(f"""
WITH {q.CASES}, {ASKED}, {q.bm25('cases', 'asked')}
SELECT doc_id, term, tf FROM bm25_postings""")
def index_postings(spark, sf):
    return bm25_index(_docs(spark, sf)).postings()


@registered(f"""
WITH {q.CASES}, {ASKED}, {q.bm25('cases', 'asked')}
SELECT term, df, round(idf, 6) AS idf FROM bm25_terms""")
def index_terms(spark, sf):
    terms = bm25_index(_docs(spark, sf)).terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@registered(f"""
WITH {q.CASES}, {ASKED}, {q.bm25('cases', 'asked')}
SELECT n AS n_docs, round(avg_len, 6) AS avg_len FROM bm25_stats""")
def index_stats(spark, sf):
    stats = bm25_index(_docs(spark, sf)).stats()
    return stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


# --- Search ---------------------------------------------------------------------


@registered(f"""
WITH {q.CASES}, {ASKED}, {q.bm25('cases', 'asked', k=10)}
SELECT qid, rank, doc_id, score FROM bm25""")
def search_bm25(spark, sf):
    return bm25_search(narratives(spark, sf), bm25_index(_docs(spark, sf)), 10)


@registered(f"""
WITH {q.CASES}, {ASKED}, {q.bm25('cases', 'asked', k=10)}
SELECT qid, rank, doc_id, score FROM bm25""")
def search_segments(spark, sf):
    """The same search in an index that took the documents in bit by bit.

    Two thirds come first, half of them in an outdated version; two runs of a stream bring the
    right versions and the rest.
    """
    docs = written(_docs(spark, sf), "segment-docs")
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    index = SegmentedIndex(spark, fresh_path(spark, "segments"))
    outdated = F.when(third == 1, F.concat(F.lit("outdated "), F.substring("text", 1, 200))).otherwise(F.col("text"))
    index.add(docs.where(third < 2).select("doc_id", outdated.alias("text")))
    arrivals, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "arrivals-checkpoint")
    for part in (1, 2):
        docs.where(third == part).write.mode("append").parquet(arrivals)
        index.take_stream(narrative_stream(spark, arrivals, docs.schema), checkpoint).awaitTermination()
    return index.search(narratives(spark, sf), 10)


@registered(f"""
WITH {q.CASES}, {ASKED}, {q.bm25('cases', 'asked')}
SELECT qid, term, qtf, df, tf AS occurrences, round(idf, 6) AS idf
FROM (SELECT qid, term, count(*) AS qtf FROM bm25_asked GROUP BY ALL) JOIN bm25_terms USING (term)
JOIN (SELECT term, sum(tf)::BIGINT AS tf FROM bm25_postings GROUP BY term) USING (term)""")
def match_query_terms(spark, sf):
    """The postings of each query's terms, summed up; the scores are made of them."""
    index = bm25_index(_docs(spark, sf))
    asked = query_terms(narratives(spark, sf)).join(index.terms.drop("term_no"), "term")
    found = index.of_terms(asked).groupBy("term").agg(F.sum("tf").alias("occurrences"))
    return asked.join(found, "term").select(
        "qid", "term", F.col("qtf").cast("bigint").alias("qtf"), "df", "occurrences",
        F.round("idf", 6).alias("idf"),
    )


@registered(f"""
WITH {ASKED}
SELECT qid, term, count(*) AS qtf
FROM (SELECT qid, unnest({q.tokens('text')}) AS term FROM asked) GROUP BY ALL""")
def query_term_counts(spark, sf):
    return query_terms(narratives(spark, sf)).select(
        "qid", "term", F.col("qtf").cast("bigint").alias("qtf")
    )


@registered(f"""
WITH {q.CASES}, {ASKED}, {q.tfidf_search('cases', 'asked', k=10)}
SELECT qid, rank, doc_id, score FROM cosine""")
def search_tfidf(spark, sf):
    return tfidf_search(narratives(spark, sf), _docs(spark, sf), 10)


@registered(f"SELECT vec_id, e.i AS i, round(u[e.i], 6) AS x FROM (SELECT vec_id, {q.unit('embedding')} AS u, "
            "unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e")
def unit_embeddings(spark, sf):
    units = with_unit_vectors(read_table(spark, sf, "embeddings"), "embedding").select(
        "vec_id", F.posexplode_outer("vector").alias("i", "x")
    )
    return units.select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


VECTORS = f"vectors AS (SELECT vec_id AS doc_id, {q.unit('embedding')} AS vector, label FROM embeddings)"
# 50 per label, the sampling operator of the benchmark builder.
VECTOR_QUERIES = """
vector_queries AS (SELECT doc_id AS qid, vector, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label
    ORDER BY md5('42|' || doc_id), doc_id) AS r FROM vectors) WHERE r <= 50)"""


def _vectors(spark, sf):
    return with_unit_vectors(read_table(spark, sf, "embeddings"), "embedding").select(
        F.col("vec_id").alias("doc_id"), "vector", "label"
    )


def _vector_queries(spark, sf):
    sample = ranking.sample_per_group(_vectors(spark, sf), "label", "doc_id", 50)
    return sample.withColumnRenamed("doc_id", "qid")


@registered(f"WITH {VECTORS}, {VECTOR_QUERIES}, {q.dense('vectors', 'vector_queries', k=20)} "
            "SELECT qid, rank, doc_id, score FROM dense")
def search_dense(spark, sf):
    return dense_search(_vector_queries(spark, sf), _vectors(spark, sf), 20)


@registered(f"WITH {VECTORS}, {VECTOR_QUERIES}, {q.dense('vectors', 'vector_queries', k=20)} "
            "SELECT qid, rank, doc_id, score FROM dense")
def search_dense_blocks(spark, sf):
    """The same search in several passes, as for very many queries."""
    return dense_search(
        _vector_queries(spark, sf), _vectors(spark, sf), 20,
        query_cells=5_000,
    )


@registered()
def search_approximate(spark, sf):
    """The same search by coarse cells and product codes; a test holds its recall to at least 0.9."""
    return VectorIndex.build(_vectors(spark, sf)).search(_vector_queries(spark, sf), 20)


@registered(f"""
WITH {VECTORS}, centres AS (
  SELECT label, list(m ORDER BY i) AS centre FROM (
    SELECT label, i, avg(vector[i]) AS m FROM
      (SELECT label, vector, unnest(range(1, len(vector) + 1)) AS i FROM vectors)
    GROUP BY label, i) GROUP BY label)
SELECT doc_id, round(list_inner_product(vector, centre), 6) AS score
FROM vectors JOIN centres USING (label)""")
def similarity_to_centre(spark, sf):
    """Inner product of each vector with the mean of its label, column by column."""
    vectors = _vectors(spark, sf)
    means = vectors.select("label", F.posexplode_outer("vector").alias("i", "x")).groupBy("label", "i").agg(
        F.avg("x").alias("m")
    )
    centres = means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p.m).alias("centre")
    )
    return vectors.join(centres, "label").select(
        "doc_id", F.round(inner_product(F.col("vector"), F.col("centre")), 6).alias("score")
    )


# --- Hybrid: all documents; some have a vector ---------------------------------------

HYBRID = f"""
{VECTORS},
docs AS (SELECT doc_id, {q.cleaned('text')} AS text, lang, vector
         FROM documents LEFT JOIN vectors USING (doc_id)),
docs_v AS (SELECT * FROM docs WHERE vector IS NOT NULL),
hybrid_split AS (
  SELECT *, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM docs),
hybrid_test AS (
  SELECT * FROM hybrid_split WHERE r > n * 70 // 100 + (n - n * 70 // 100) // 2),
hybrid_queries AS (
  SELECT doc_id AS qid, text, lang, vector FROM (
    SELECT doc_id, text, lang, vector,
           row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS p
    FROM hybrid_test) WHERE p <= 50),
queries_v AS (SELECT * FROM hybrid_queries WHERE vector IS NOT NULL),
hybrid_qrels AS (
  SELECT qid, doc_id, CAST(1 AS BIGINT) AS rel FROM (
    SELECT qid, d.doc_id, row_number() OVER (PARTITION BY qid ORDER BY d.doc_id) AS r
    FROM hybrid_queries JOIN docs d USING (lang) WHERE qid <> d.doc_id) WHERE r <= 30)"""


def _hybrid(spark, sf):
    """All documents, vectors where there are some, benchmark queries among them, judgments."""
    vectors = _vectors(spark, sf).drop("label")
    docs = written(
        documents(spark, sf, "doc_id", "text", "lang").join(vectors, "doc_id", "left").select(
            "doc_id", F.col("lang").alias("primary_category"), "vector",
            text.clean(F.col("text")).alias("text"),
        ),
        "hybrid",
    )
    ids = docs.select("doc_id", "primary_category")
    test = stratified_split(ids, id_column="doc_id").where("split = 'test'")
    asked = ranking.sample_per_group(test, "primary_category", "doc_id", 50)
    queries = written(
        docs.join(asked.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "qid"),
        "hybrid-queries",
    )
    as_ids = lambda df: df.withColumnRenamed("doc_id", "complaint_id")
    qrels = same_category(as_ids(ids), as_ids(asked))
    return docs, queries, qrels


def _with_vector(rows):
    return rows.where("vector IS NOT NULL")


@registered(f"""
WITH {HYBRID}, {q.bm25('docs', 'hybrid_queries', k=50)}, {q.dense('docs_v', 'queries_v', k=50)},
{q.fused('bm25', 'dense', k=20)}
SELECT qid, rank, doc_id, score FROM fused""")
def search_hybrid(spark, sf):
    docs, queries, _ = _hybrid(spark, sf)
    sparse = bm25_search(queries, bm25_index(docs), 50)
    dense = dense_search(_with_vector(queries), _with_vector(docs), 50)
    return fuse(sparse, dense, 20)


@registered(f"""
WITH {HYBRID}, {q.bm25('docs', 'hybrid_queries', k=50)},
{q.tfidf_search('docs', 'hybrid_queries', k=20)}, {q.dense('docs_v', 'queries_v', k=50)},
{q.fused('bm25', 'dense', k=20)},
rankings AS (
  SELECT 'bm25' AS retriever, qid, rank, doc_id FROM bm25 WHERE rank <= 20
  UNION ALL SELECT 'tfidf', qid, rank, doc_id FROM cosine
  UNION ALL SELECT 'dense', qid, rank, doc_id FROM dense WHERE rank <= 20
  UNION ALL SELECT 'rrf', qid, rank, doc_id FROM fused),
{q.query_metrics('rankings', 'hybrid_qrels')}
{q.mean_metrics(['bm25', 'tfidf', 'dense', 'rrf'], 'hybrid_queries')}""")
def compare_retrievers(spark, sf):
    """Four rankings of the benchmark queries, scored in one pass."""
    docs, queries, qrels = _hybrid(spark, sf)
    words = tokenised(docs)
    sparse = written(bm25_search(queries, bm25_index(words), 50), "ranking")
    dense = written(dense_search(_with_vector(queries), _with_vector(docs), 50), "ranking")
    rankings = {
        "bm25": sparse.where("rank <= 20"),
        "tfidf": tfidf_search(queries, words, 20),
        "dense": dense.where("rank <= 20"),
        "rrf": fuse(sparse, dense, 20),
    }
    return metrics.compare(rankings, qrels, queries)


# --- Scoring a ranking ----------------------------------------------------------------

# A ranking that needs no index: documents of the query's class and source by hash
# order, against graded judgments.
SIMPLE = f"""
{q.SPLIT},
asked AS (SELECT complaint_id, primary_category, original_issue FROM split WHERE split = 'test'
          ORDER BY md5('42|' || complaint_id), complaint_id LIMIT 300),
qrels AS (
  SELECT a.complaint_id AS qid, k.complaint_id AS doc_id, CAST(2 AS BIGINT) AS rel
  FROM asked a JOIN keys k USING (primary_category, original_issue)
  WHERE a.complaint_id <> k.complaint_id
  UNION ALL
  SELECT qid, doc_id, 1 FROM (
    SELECT a.complaint_id AS qid, k.complaint_id AS doc_id,
           row_number() OVER (PARTITION BY a.complaint_id ORDER BY k.complaint_id) AS r
    FROM asked a JOIN keys k USING (primary_category)
    WHERE a.complaint_id <> k.complaint_id AND a.original_issue <> k.original_issue)
  WHERE r <= 20),
rankings AS (
  SELECT 'simple' AS retriever, qid, rank, doc_id FROM (
    SELECT a.complaint_id AS qid, k.complaint_id AS doc_id,
           row_number() OVER (PARTITION BY a.complaint_id
                              ORDER BY md5('7|' || k.complaint_id), k.complaint_id) AS rank
    FROM asked a JOIN keys k USING (original_issue)) WHERE rank <= 20)"""


def _simple(spark, sf):
    table = keys(spark, sf)
    test = split_keys(spark, sf).where("split = 'test'")
    asked = written(ranking.sample_rows(test, "complaint_id", 300), "asked")
    first = ranking.sample_per_group(table, "original_issue", "complaint_id", 20, seed=7)
    hits = asked.select(F.col("complaint_id").alias("qid"), "original_issue").join(
        first.select("original_issue", F.col("complaint_id").alias("doc_id")), "original_issue"
    )
    order = [ranking.hash_key("doc_id", 7), F.col("doc_id")]
    ranked = ranking.first_per_group(hits, ["qid"], order, 20, rank="rank")
    return ranked.withColumn("rank", F.col("rank").cast("bigint")), graded(table, asked), asked


@registered(f"""
WITH {SIMPLE}
SELECT r.qid, r.rank, r.doc_id, coalesce(j.rel, 0) AS rel
FROM rankings r LEFT JOIN qrels j ON r.qid = j.qid AND r.doc_id = j.doc_id""")
def join_hit_judgments(spark, sf):
    hits, qrels, _ = _simple(spark, sf)
    return metrics.judged(hits, qrels).select("qid", "rank", "doc_id", F.col("rel").cast("bigint").alias("rel"))


@registered(f"""
WITH {SIMPLE}
SELECT r.qid, r.rank, (sum(CASE WHEN j.rel > 0 THEN 1 ELSE 0 END)
                       OVER (PARTITION BY r.qid ORDER BY r.rank))::BIGINT AS hits
FROM rankings r LEFT JOIN qrels j ON r.qid = j.qid AND r.doc_id = j.doc_id""")
def running_hits(spark, sf):
    hits, qrels, _ = _simple(spark, sf)
    return metrics.running_hits(metrics.judged(hits, qrels), ["qid"]).select("qid", "rank", "hits")


@registered(f"""
WITH {SIMPLE}
SELECT qid, rank, rel FROM (
  SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS rank FROM qrels)
WHERE rank <= 10""")
def ideal_order(spark, sf):
    _, qrels, _ = _simple(spark, sf)
    return metrics.ideal_order(qrels, 10).select("qid", F.col("rank").cast("bigint").alias("rank"), "rel")


def _per_query(columns):
    picked = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    sql = f"WITH {SIMPLE}, {q.query_metrics('rankings', 'qrels')} SELECT qid, {picked} FROM scored"

    def query(spark, sf):
        hits, qrels, _ = _simple(spark, sf)
        scored = metrics.query_metrics(hits, qrels)
        return scored.select("qid", *[F.round(c, 6).alias(c) for c in columns])

    return query, sql


for _name, _columns in {
    "ndcg_per_query": ["ndcg_5", "ndcg_10"],
    "mrr_per_query": ["mrr_10"],
    "recall_per_query": ["recall_1", "recall_5", "recall_10", "recall_20"],
    "precision_per_query": ["precision_1", "precision_5", "precision_10"],
    "average_precision_per_query": ["map_10"],
}.items():
    _query, _sql = _per_query(_columns)
    _query.__name__ = _name
    registered(_sql)(_query)


@registered(f"""
WITH {SIMPLE}, {q.query_metrics('rankings', 'qrels')},
everyone AS (SELECT complaint_id AS qid FROM split)
{q.mean_metrics(['simple'], 'everyone')}""")
def evaluate_ranking(spark, sf):
    """Means over all documents as queries, most of them without any result."""
    hits, qrels, _ = _simple(spark, sf)
    everyone = keys(spark, sf).select(F.col("complaint_id").alias("qid"))
    return metrics.evaluate({"simple": hits}, qrels, everyone)


@registered(f"""
WITH {SIMPLE}
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
FROM (SELECT qid, doc_id, round(1e0 / rank, 1) AS score FROM rankings)""")
def rank_in_list(spark, sf):
    hits, _, _ = _simple(spark, sf)
    scored = hits.select("qid", "doc_id", F.round(1 / F.col("rank"), 1).alias("score"))
    return ranking.rank_list(scored).select("qid", "doc_id", "rank")


# --- Triage ---------------------------------------------------------------------------


def _line(rank="rank", score="score", doc="doc_id", category="category", source="source"):
    return (
        f"'#' || {rank} || ' [Score: ' || printf('%.4f', {score} + 1e-9) || '] - ID: ' || {doc}"
        f" || ' | Category: ' || coalesce({category}, 'unknown')"
        f" || ' | Source: ' || coalesce({source}, 'N/A')"
    )


@registered(f"""
WITH {q.CASES}, {ASKED}, {q.bm25('cases', 'asked', k=3)},
hits AS (SELECT qid, rank, doc_id, score FROM bm25 UNION ALL SELECT qid, 4, -1, 0e0 FROM asked)
SELECT b.qid, b.rank, b.doc_id, b.score, coalesce(category, 'unknown') AS category,
       coalesce(source, 'N/A') AS source, {_line(doc='b.doc_id')} AS line,
       coalesce(text, '') AS passage
FROM hits b LEFT JOIN cases k ON k.doc_id = b.doc_id""")
def case_summaries(spark, sf):
    """Hits with their documents; each query also has a hit on a document that is not there."""
    docs = cases(spark, sf)
    asked = narratives(spark, sf)
    hits = bm25_search(asked, bm25_index(docs.select("doc_id", "text")), 3)
    absent = asked.select(
        "qid", F.lit(4).cast("bigint").alias("rank"), F.lit(-1).cast("bigint").alias("doc_id"),
        F.lit(0.0).alias("score"),
    )
    return case_lines(hits.unionByName(absent), docs)


BAYES = ",".join([
    q.tfidf_fit("cases", "nb", min_df=2),
    q.tfidf_vectors("nb_tf", "nb_voc", "nb_vec"),
    """
nb_mass AS (SELECT category, term, sum(weight) AS mass
            FROM nb_vec JOIN cases USING (doc_id) GROUP BY ALL),
nb_class AS (SELECT category, ln(count(*) / (SELECT count(*) FROM cases)) AS prior
             FROM cases GROUP BY category),
nb_total AS (SELECT category, ln(coalesce(sum(mass), 0)
                    + 0.1e0 * (SELECT count(*) FROM nb_voc)) AS total
             FROM nb_class LEFT JOIN nb_mass USING (category) GROUP BY category)""",
])


def _bayes_scores(queries: str) -> str:
    return ",".join([
        q.query_tf(queries, "nb_qtf"),
        q.tfidf_vectors("nb_qtf", "nb_voc", "nb_q", "qid"),
        f"""
nb_scores AS (
  SELECT x.qid, c.category, any_value(c.prior)
         + coalesce(sum(v.weight * (ln(coalesce(m.mass, 0) + 0.1e0) - t.total)), 0) AS s
  FROM {queries} x CROSS JOIN nb_class c JOIN nb_total t USING (category)
  LEFT JOIN nb_q v ON v.qid = x.qid
  LEFT JOIN nb_mass m ON m.category = c.category AND m.term = v.term
  GROUP BY x.qid, c.category),
nb_pred AS (
  SELECT qid, arg_max(category, s) AS prediction,
         round(100e0 / sum(exp(s - top)), 4) AS confidence
  FROM (SELECT *, max(s) OVER (PARTITION BY qid) AS top FROM nb_scores) GROUP BY qid)""",
    ])


CLEAN_ASKED = f"asked AS (SELECT item_id AS qid, {q.cleaned('text')} AS text FROM benchmark)"


TRIAGE_SQL = f"""
WITH {q.CASES}, {CLEAN_ASKED}, {q.bm25('cases', 'asked', k=3)}, {BAYES}, {_bayes_scores('asked')}
SELECT a.qid, prediction, confidence, rank, b.doc_id, score, category, source,
       {_line(doc='b.doc_id')} AS line, c.text AS passage
FROM asked a JOIN nb_pred USING (qid) LEFT JOIN bm25 b ON b.qid = a.qid
LEFT JOIN cases c ON c.doc_id = b.doc_id"""


@registered(TRIAGE_SQL)
def triage(spark, sf):
    """Clean, classify and look up three similar cases for every narrative."""
    engine = TriageEngine.fit(written(cases(spark, sf), "cases"))
    return engine.triage(narratives(spark, sf), 3).withColumn(
        "confidence", F.round("confidence", 4)
    )


@registered(TRIAGE_SQL)
def triage_loaded(spark, sf):
    """The same by an engine that was saved and read back."""
    path = fresh_path(spark, "triage-engine")
    TriageEngine.fit(written(cases(spark, sf), "cases")).save(path)
    return TriageEngine.load(spark, path).triage(narratives(spark, sf), 3).withColumn(
        "confidence", F.round("confidence", 4)
    )


def _triage_with_vectors(hits: str, searches: str) -> str:
    return f"""
WITH {q.CASES}, {HYBRID}, {searches}, {BAYES}, {_bayes_scores('queries_v')}
SELECT a.qid, prediction, confidence, rank, b.doc_id, score, category, source,
       {_line(doc='b.doc_id')} AS line, c.text AS passage
FROM queries_v a JOIN nb_pred USING (qid) LEFT JOIN {hits} b ON b.qid = a.qid
LEFT JOIN cases c ON c.doc_id = b.doc_id"""


def _triaged_with_vectors(spark, sf, method):
    docs, queries, _ = _hybrid(spark, sf)
    asked = _with_vector(queries)
    dense = dense_search(asked, _with_vector(docs), 50)
    engine = TriageEngine.fit(written(cases(spark, sf), "cases"))
    return engine.triage(asked.select("qid", "text"), 3, dense, method).withColumn(
        "confidence", F.round("confidence", 4)
    )


@registered(_triage_with_vectors("dense", q.dense("docs_v", "queries_v", k=3)))
def triage_dense(spark, sf):
    """Narratives that have a vector, looked up by it."""
    return _triaged_with_vectors(spark, sf, "dense")


@registered(_triage_with_vectors("fused", ",".join([
    q.bm25("docs", "queries_v", k=50), q.dense("docs_v", "queries_v", k=50),
    q.fused("bm25", "dense", k=3)])))
def triage_hybrid(spark, sf):
    """BM25 over all cases fused with the vectors' ranking."""
    return _triaged_with_vectors(spark, sf, "hybrid")


STREAM_RULES = [
    ("legal", [r"license|copyright"]),
    ("short", [r"^.{0,120}$"]),
]
STREAM_SQL_LABEL = """CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'legal'
     WHEN regexp_matches(lower(text), '^.{0,120}$') THEN 'short' ELSE 'other' END"""


@registered(f"""
WITH {q.CASES}, {CLEAN_ASKED}, {q.bm25('cases', 'asked', k=3)}
SELECT a.qid, {STREAM_SQL_LABEL} AS category, rank, doc_id, score
FROM asked a LEFT JOIN bm25 b ON b.qid = a.qid""")
def triage_arriving(spark, sf):
    """The benchmark passages as a stream against a static index."""
    index = bm25_index(_docs(spark, sf))
    arriving = narrative_stream(
        spark, f"{sf}/benchmark.parquet*", "item_id bigint, text string"
    ).select(F.col("item_id").alias("qid"), "text")
    out, checkpoint = fresh_path(spark, "triaged"), fresh_path(spark, "triage-checkpoint")
    stream = triage_stream(arriving, index, out, checkpoint, 3, rules=STREAM_RULES, default="other")
    stream.awaitTermination()
    return spark.read.parquet(out).drop("batch")


@registered(f"""
WITH {q.CASES}, {CLEAN_ASKED}, {q.bm25('cases', 'asked', k=3)}
SELECT a.qid, {STREAM_SQL_LABEL} AS category, rank, doc_id, score
FROM asked a LEFT JOIN bm25 b ON b.qid = a.qid""")
def triage_by_rules(spark, sf):
    """The batch form of the streaming triage."""
    labelled = rule_labelled(narratives(spark, sf), rules=STREAM_RULES, default="other")
    return triaged(labelled, bm25_index(_docs(spark, sf)), 3)
