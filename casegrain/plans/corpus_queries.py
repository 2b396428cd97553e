"""Registered queries: building, splitting and auditing a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.functions import text
from casegrain.operators import audit, metrics, ranking, records
from casegrain.operators.benchmark import (
    build_benchmark,
    build_graded_benchmark,
    graded,
    same_category,
)
from casegrain.operators.corpus import (
    build_corpus,
    deficits,
    harmonize,
    ingest_agency,
    ingest_source,
    load_fraud_mail,
    load_hate_speech,
    load_labelled,
    load_regulator,
    load_sms_spam,
    top_up,
)
from casegrain.operators.splitting import split_parity, stratified_split
from casegrain.operators.terms import computed_once
from casegrain.plans import sql as q
from casegrain.plans.catalog import registered
from casegrain.plans.standins import (
    corpus,
    documents,
    kept_corpus,
    keys,
    split_keys,
    test_queries,
    texts,
)
from casegrain.plans.text_queries import rules_sql
from casegrain.sources import writers
from casegrain.sources.readers import concatenate
from casegrain.workspace import fresh_path, read_table, written

LANGS = ["en", "fr", "de", "es"]

# --- Statistics -----------------------------------------------------------------


@registered("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def count_by_class(spark, sf):
    return audit.count_by(read_table(spark, sf, "documents"), "lang")


@registered("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, sf):
    return audit.count_by(read_table(spark, sf, "documents"), "source")


@registered("""
SELECT lang, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent
FROM documents GROUP BY lang""")
def class_share(spark, sf):
    return audit.share_by(read_table(spark, sf, "documents"), "lang")


@registered(f"""
WITH {q.CORPUS}
SELECT unnest([50, 75, 90, 95, 99])::BIGINT AS percentile,
       round(unnest(quantile_cont(word_count::DOUBLE, [0.5, 0.75, 0.9, 0.95, 0.99])), 6) AS value
FROM corpus""")
def word_percentiles(spark, sf):
    return audit.percentiles(corpus(spark, sf), "word_count")


@registered(f"""
WITH {q.CORPUS}
SELECT min(word_count)::DOUBLE AS min, round(quantile_cont(word_count::DOUBLE, 0.25), 6) AS p25,
       round(quantile_cont(word_count::DOUBLE, 0.5), 6) AS p50,
       round(quantile_cont(word_count::DOUBLE, 0.75), 6) AS p75,
       max(word_count)::DOUBLE AS max, round(avg(word_count), 6) AS mean,
       round(stddev_samp(word_count), 6) AS stddev
FROM corpus""")
def length_summary(spark, sf):
    return audit.length_summary(corpus(spark, sf), "word_count")


@registered(f"""
WITH {q.CORPUS}
SELECT count(DISTINCT word) AS vocabulary
FROM (SELECT unnest({q.tokens('cleaned_text')}) AS word FROM corpus)""")
def vocabulary_size(spark, sf):
    return audit.vocabulary_size(corpus(spark, sf), "cleaned_text")


@registered("""
WITH joined AS (SELECT d.doc_id, d.lang, l.quality, l.toxic
                FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS "column", count(*) FILTER (WHERE doc_id IS NULL) AS nulls FROM joined
UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM joined
UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM joined
UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM joined""")
def null_counts(spark, sf):
    joined = read_table(spark, sf, "documents").select("doc_id", "lang").join(
        read_table(spark, sf, "labels"), "doc_id", "left"
    )
    return audit.null_counts(joined, ["doc_id", "lang", "quality", "toxic"])


@registered(f"""
WITH {q.CORPUS}
SELECT count(*) - count(DISTINCT cleaned_text) AS duplicates FROM corpus""")
def duplicate_texts(spark, sf):
    return audit.duplicates(corpus(spark, sf), "cleaned_text")


@registered("""
SELECT DISTINCT lang, source, doc_id,
       count(*) OVER (PARTITION BY lang) AS in_category,
       count(*) OVER (PARTITION BY lang, source) AS in_issue
FROM documents""")
def ids_per_category(spark, sf):
    """The category index as rows; a set per category would not fit a task."""
    table = read_table(spark, sf, "documents").select("lang", "source", "doc_id").distinct()
    issues = table.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("in_issue"))
    categories = issues.groupBy("lang").agg(F.sum("in_issue").alias("in_category"))
    sizes = written(issues.join(categories, "lang"), "category-sizes")
    return table.join(sizes, ["lang", "source"])


@registered(f"""
WITH {q.CORPUS}
SELECT unnest([{', '.join(f"'{t}'" for t in fixed.MASK_TOKENS)}]) AS token,
       unnest([{', '.join(
           f"sum((length(cleaned_text) - length(replace(cleaned_text, '{t}', ''))) / {len(t)})::BIGINT"
           for t in fixed.MASK_TOKENS)}]) AS n
FROM corpus""")
def mask_totals(spark, sf):
    return audit.mask_totals(corpus(spark, sf))


@registered(f"""
WITH {q.CORPUS}
SELECT {', '.join(
    f"count(*) FILTER (WHERE regexp_matches(cleaned_text, '{p}')) AS {n}"
    for n, p in [("emails", fixed.EMAIL_PATTERN), ("phones", fixed.PHONE_PATTERN),
                 ("cards", fixed.CARD_PATTERN)])}
FROM corpus""")
def residual_pii(spark, sf):
    return audit.residual_pii(corpus(spark, sf))


@registered(f"""
WITH {q.CORPUS},
edges AS (SELECT min(word_count) AS low, max(word_count) AS high FROM corpus)
SELECT bin, count(word_count) AS n
FROM range(1, 36) t(bin)
LEFT JOIN (SELECT word_count, least((word_count - low) * 35 // (high - low), 34) + 1 AS bin
           FROM corpus, edges) USING (bin)
GROUP BY bin""")
def word_histogram(spark, sf):
    return audit.histogram(corpus(spark, sf), "word_count")


# --- Order and samples ------------------------------------------------------------


@registered("""
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
WHERE r <= 20""")
def first_per_class(spark, sf):
    table = read_table(spark, sf, "documents").select("doc_id", "lang")
    return ranking.first_per_group(table, ["lang"], ["doc_id"], 20)


@registered(f"""
WITH {q.CORPUS}
SELECT complaint_id, cleaned_text FROM (
  SELECT *, row_number() OVER (PARTITION BY cleaned_text ORDER BY source, complaint_id) AS r
  FROM corpus) WHERE r = 1""")
def keep_first_duplicate(spark, sf):
    kept = ranking.keep_first(corpus(spark, sf), "cleaned_text", ["source", "complaint_id"])
    return kept.select("complaint_id", "cleaned_text")


@registered(f"""
WITH {q.KEYS}
SELECT complaint_id, primary_category FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_category
                               ORDER BY md5('42|' || complaint_id), complaint_id) AS r FROM keys)
WHERE r <= 50""")
def sample_per_class(spark, sf):
    sample = ranking.sample_per_group(keys(spark, sf), "primary_category", "complaint_id", 50)
    return sample.select("complaint_id", "primary_category")


@registered(f"""
WITH {q.KEYS}
SELECT complaint_id FROM keys ORDER BY md5('42|' || complaint_id), complaint_id LIMIT 300""")
def sample_overall(spark, sf):
    return ranking.sample_rows(keys(spark, sf), "complaint_id", 300).select("complaint_id")


@registered(f"""
WITH {q.KEYS}
SELECT complaint_id, primary_category,
       row_number() OVER (PARTITION BY primary_category
                          ORDER BY md5('42|' || complaint_id), complaint_id) AS group_rank,
       count(*) OVER (PARTITION BY primary_category) AS group_size FROM keys""")
def rank_in_class(spark, sf):
    ranked = ranking.ranked_in_group(keys(spark, sf), "primary_category", "complaint_id")
    return ranked.select("complaint_id", "primary_category", "group_rank", "group_size")


@registered("""
SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars
FROM documents GROUP BY source ORDER BY mean_chars DESC, source LIMIT 1""")
def best_source(spark, sf):
    table = read_table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars")
    )
    return ranking.best_row(table, "mean_chars", "source")


# --- Set operations -----------------------------------------------------------------

SOURCES_SQL = f"""
merged AS (
  SELECT 0 AS source_rank, 'documents' AS source, CAST(doc_id AS VARCHAR) AS complaint_id,
         lang AS primary_category, text AS raw_text, {q.cleaned('text')} AS cleaned_text
  FROM documents
  UNION ALL
  SELECT 1, 'conversations', conv_id || '-' || turn, role, text, {q.cleaned('text')}
  FROM conversations
  UNION ALL
  SELECT 2, 'pages', CAST(page_id AS VARCHAR), NULL, html, {q.cleaned('html')} FROM pages)"""


def three_sources(spark, sf):
    """Three tables of different shape as records; pages have no category."""
    record = lambda table, source, ident, category, raw: computed_once(
        table.select(
            F.lit(source).alias("source"),
            ident.cast("string").alias("complaint_id"),
            *([F.col(category).alias("primary_category")] if category else []),
            F.col(raw).alias("raw_text"),
        ),
        "cleaned_text",
        text.clean(F.col("raw_text")),
    )
    return [
        record(documents(spark, sf, "doc_id", "lang", "text"), "documents", F.col("doc_id"), "lang", "text"),
        record(
            texts(spark, sf, "conversations"), "conversations",
            F.concat_ws("-", "conv_id", "turn"), "role", "text",
        ),
        record(texts(spark, sf, "pages"), "pages", F.col("page_id"), None, "html"),
    ]


@registered(f"WITH {SOURCES_SQL} SELECT source, complaint_id, primary_category, raw_text FROM merged")
def concatenate_sources(spark, sf):
    merged = concatenate(three_sources(spark, sf))
    return merged.select("source", "complaint_id", "primary_category", "raw_text")


@registered("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf):
    ids = lambda name: read_table(spark, sf, name).select("doc_id")
    return ids("documents").subtract(ids("labels"))


@registered("SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def set_intersection(spark, sf):
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return read_table(spark, sf, "documents").select("doc_id").intersect(vectors)


@registered("""
SELECT lang, 'unexpected' AS problem FROM
  (SELECT lang FROM documents EXCEPT SELECT * FROM (VALUES ('en'), ('fr'), ('it')))
UNION ALL
SELECT lang, 'missing' FROM
  (SELECT col0 AS lang FROM (VALUES ('en'), ('fr'), ('it')) EXCEPT SELECT lang FROM documents)""")
def label_set_difference(spark, sf):
    return audit.label_difference(read_table(spark, sf, "documents"), "lang", ["en", "fr", "it"])


# --- Corpora ------------------------------------------------------------------------


@registered(f"""
WITH {SOURCES_SQL}
SELECT source, complaint_id, primary_category, cleaned_text FROM (
  SELECT *, row_number() OVER (PARTITION BY cleaned_text ORDER BY source_rank, complaint_id) AS r
  FROM merged WHERE primary_category IS NOT NULL AND {q.words('cleaned_text')} >= 5)
WHERE r = 1""")
def harmonize_sources(spark, sf):
    master = harmonize(three_sources(spark, sf))
    return master.select("source", "complaint_id", "primary_category", "cleaned_text")


@registered(f"""
SELECT CAST(doc_id AS VARCHAR) AS complaint_id, '{fixed.AGENCY_SOURCE}' AS source,
       DATE '{fixed.AGENCY_DATE}' AS date_received, '{fixed.AGENCY_PRODUCT}' AS product,
       text AS raw_text, c AS cleaned_text, {rules_sql("source || ' ' || c")} AS primary_category,
       source AS original_issue
FROM (SELECT *, {q.cleaned('text')} AS c FROM documents)""")
def ingest_labelled_agency(spark, sf):
    return ingest_agency(
        documents(spark, sf, "doc_id", "text", "source"), "text", "source", "doc_id"
    )


@registered(f"""
SELECT CASE WHEN k > 1 THEN id || '-' || k ELSE id END AS complaint_id, 'police' AS source,
       DATE '{fixed.AGENCY_DATE}' AS date_received, '{fixed.AGENCY_PRODUCT}' AS product,
       html AS raw_text, c AS cleaned_text, {rules_sql('c')} AS primary_category,
       '{fixed.AGENCY_ISSUE}' AS original_issue
FROM (SELECT *, row_number() OVER (PARTITION BY id) AS k FROM (
  SELECT html, {q.cleaned('html')} AS c, 'police_' || md5('police|' || html) AS id FROM pages))""")
def ingest_report_dump(spark, sf):
    # The text column goes by a name that has to be found.
    dump = texts(spark, sf, "pages").withColumnRenamed("html", "Incident_Report")
    return ingest_source(
        dump.select("page_id", "Incident_Report"), "police",
        words=fixed.TEXT_COLUMN_WORDS["police"],
    )


def _loaded_sql(raw: str, prefix: str, source: str, category: str, rest: str) -> str:
    return f"""
SELECT CASE WHEN k > 1 THEN id || '-' || k ELSE id END AS complaint_id, {source} AS source,
       {category} AS primary_category, raw AS raw_text, c AS cleaned_text,
       {q.words('c')} AS word_count
FROM (SELECT *, row_number() OVER (PARTITION BY id) AS k
      FROM (SELECT *, {q.cleaned('raw')} AS c, {prefix} || md5({source} || '|' || raw) AS id
            FROM (SELECT *, {raw} AS raw FROM {rest})))"""


def _literals(loader):
    """A loader's id prefix, source and category as SQL strings."""
    return [f"'{x}'" for x in loader]


EDGES = f"'^{q.BLANKS}+|{q.BLANKS}+$', '', 'g'"
STRIPPED = f"regexp_replace(text, {EDGES})"
HATE_SAMPLE = 100
HATE_SQL = _loaded_sql(
    STRIPPED, *_literals(fixed.HATE_SPEECH),
    f"""(SELECT text FROM conversations WHERE turn IN (0, 1)
         ORDER BY md5('42|' || md5({STRIPPED})), md5({STRIPPED}) LIMIT {HATE_SAMPLE})""",
)
RULES = list(zip(*fixed.REGULATOR_RULES))
REGULATOR_SQL = _loaded_sql(
    "text", *(f"{list(values)}[rule]" for values in RULES[:3]),
    f"""(SELECT rule, text FROM (
         SELECT *, row_number() OVER (PARTITION BY rule ORDER BY md5(text), doc_id) AS r FROM (
           SELECT 1 AS rule, doc_id, text FROM documents
           WHERE regexp_matches(lang, '(?i)FR') OR regexp_matches(source, '(?i)src1|src2')
           UNION ALL SELECT 2, doc_id, text FROM documents WHERE regexp_matches(lang, '(?i)de')
           UNION ALL SELECT 3, doc_id, text FROM documents WHERE regexp_matches(source, 'src19')))
       WHERE r <= {fixed.REGULATOR_CAP})""",
)


SPAM_SQL = _loaded_sql(
    STRIPPED, *_literals(fixed.SMS_SPAM), "(SELECT * FROM conversations WHERE role = 'user')",
)
MAIL_SQL = _loaded_sql("html", *_literals(fixed.FRAUD_MAIL), "pages")
ALL_HATE_SQL = _loaded_sql(
    STRIPPED, *_literals(fixed.HATE_SPEECH), "(SELECT text FROM conversations WHERE turn IN (0, 1))")


@registered(SPAM_SQL)
def load_spam_messages(spark, sf):
    turns = texts(spark, sf, "conversations")
    label = F.when(F.col("role") == "user", "spam").otherwise("ham")
    return load_sms_spam(turns.select(label.alias("label"), "text"))


@registered(HATE_SQL)
def load_hate_speech_sample(spark, sf):
    turns = texts(spark, sf, "conversations")
    tweets = turns.select(F.col("turn").alias("class"), F.col("text").alias("tweet"))
    return load_hate_speech(tweets, HATE_SAMPLE)


@registered(MAIL_SQL)
def load_fraud_mails(spark, sf):
    mails = texts(spark, sf, "pages").select("url", F.col("html").alias("Mail Body"))
    return load_fraud_mail(mails)


def regulator_routes():
    (first, second, third) = records.REGULATOR_ROUTES
    return [
        records.Route(first.prefix, first.source, first.category,
                      [("Issue", "FR"), ("Product", "src1|src2")]),
        records.Route(second.prefix, second.source, second.category, [("Issue", "de")]),
        records.Route(third.prefix, third.source, third.category, [("Sub-issue", "src19")]),
    ]


def _complaints(spark, sf):
    return documents(spark, sf, "text", "lang", "source").select(
        F.col("text").alias(fixed.REGULATOR_TEXT),
        F.col("lang").alias("Issue"),
        F.col("source").alias("Product"),
        F.col("source").alias("Sub-issue"),
    )


@registered(REGULATOR_SQL)
def load_regulator_complaints(spark, sf):
    return load_regulator(_complaints(spark, sf), regulator_routes(), cap=fixed.REGULATOR_CAP)


@registered(f"""
SELECT complaint_id, source, primary_category, cleaned_text, word_count FROM (
  SELECT *, row_number() OVER (PARTITION BY cleaned_text ORDER BY complaint_id) AS r
  FROM ({SPAM_SQL} UNION ALL {ALL_HATE_SQL} UNION ALL {MAIL_SQL})) WHERE r = 1""")
def build_from_files(spark, sf):
    """The labelled loaders from delimited files, one of which is missing, as one corpus."""
    path = fresh_path(spark, "sources")
    turns = texts(spark, sf, "conversations")
    label = F.when(F.col("role") == "user", "spam").otherwise("ham")
    writers.write_sms(turns.select(label.alias("label"), "text"), f"{path}/sms")
    writers.write_table(turns.select(F.col("turn").alias("class"), F.col("text").alias("tweet")), f"{path}/tweets")
    writers.write_table(texts(spark, sf, "pages").select("url", F.col("html").alias("Mail Body")), f"{path}/mails")
    loaded = load_labelled(
        spark, sms=f"{path}/sms", hate_speech=f"{path}/tweets.csv", fraud_mail=f"{path}/mails.csv",
        regulator=f"{path}/absent.csv",
    )
    return build_corpus([loaded]).drop("raw_text")


DEFICITS_SQL = """
SELECT t.category AS primary_category, coalesce(n, 0) AS existing,
       greatest(0, {target} - coalesce(n, 0)) AS needed
FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) t(category)
LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON lang = t.category"""


@registered(DEFICITS_SQL.format(target=700))
def class_deficits(spark, sf):
    return deficits(keys(spark, sf), LANGS + ["it"], 700)


# The pool: conversation turns, given the languages in turn as categories.
POOL_SQL = f"""
pool AS (
  SELECT conv_id || '-' || turn AS complaint_id,
         ['en', 'fr', 'de', 'es'][turn % 4 + 1] AS primary_category,
         text AS raw_text, {q.cleaned('text')} AS cleaned_text FROM conversations),
ranked_pool AS (
  SELECT *, count(*) OVER (PARTITION BY primary_category) AS p,
         row_number() OVER (PARTITION BY primary_category
                            ORDER BY md5('42|' || complaint_id), complaint_id) - 1 AS r
  FROM pool),
needs AS ({DEFICITS_SQL.format(target=800)}),
added AS (
  SELECT 'gen_' || substr(primary_category, 1, 4) || '_' || (10000 + i) AS complaint_id,
         '{fixed.TOP_UP_SOURCE} (' || upper(primary_category[1]) || primary_category[2:] || ')' AS source,
         primary_category, raw_text, cleaned_text, {q.words('cleaned_text')} AS word_count
  FROM (SELECT *, unnest(range(r, needed, p)) AS i
        FROM ranked_pool JOIN needs USING (primary_category)))"""


def _pool(spark, sf):
    turns = texts(spark, sf, "conversations")
    langs = F.array(*[F.lit(x) for x in LANGS])
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("complaint_id"),
        F.get(langs, (F.col("turn") % 4).cast("int")).alias("primary_category"),
        F.col("text").alias("raw_text"),
    ).transform(computed_once, "cleaned_text", text.clean(F.col("raw_text")))


@registered(f"WITH {POOL_SQL} SELECT * FROM added")
def top_up_classes(spark, sf):
    return top_up(keys(spark, sf), _pool(spark, sf), LANGS + ["it"], 800)


BALANCED_SQL = f"""
{q.CORPUS}, {POOL_SQL},
merged AS (
  SELECT 0 AS source_rank, complaint_id, source, primary_category, raw_text, cleaned_text, word_count
  FROM corpus
  UNION ALL SELECT 1, complaint_id, source, primary_category, raw_text, cleaned_text, word_count
  FROM added),
balanced AS (
SELECT complaint_id, source, primary_category, cleaned_text, word_count FROM (
  SELECT *, row_number() OVER (PARTITION BY cleaned_text ORDER BY source_rank, complaint_id) AS r
  FROM merged) WHERE r = 1)"""


@registered(f"""
WITH {BALANCED_SQL}
SELECT t.category AS primary_category, coalesce(n, 0) AS existing,
       greatest(0, 800 - coalesce(n, 0)) AS needed
FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) t(category)
LEFT JOIN (SELECT primary_category, count(*) AS n FROM balanced GROUP BY primary_category) b
  ON b.primary_category = t.category""")
def deficits_left(spark, sf):
    """What the pool could not fill, after equal texts are dropped."""
    master = build_corpus([kept_corpus(spark, sf)], _pool(spark, sf), LANGS + ["it"], 800)
    return deficits(master, LANGS + ["it"], 800)


@registered(f"WITH {BALANCED_SQL} SELECT * FROM balanced")
def build_balanced_corpus(spark, sf):
    master = build_corpus([kept_corpus(spark, sf)], _pool(spark, sf), LANGS + ["it"], 800)
    return master.drop("raw_text")


# --- Splits -------------------------------------------------------------------------


@registered(f"WITH {q.SPLIT} SELECT complaint_id, primary_category, split FROM split")
def split_stratified(spark, sf):
    return split_keys(spark, sf).select("complaint_id", "primary_category", "split")


@registered(f"""
WITH {q.SPLIT}
SELECT primary_category,
       round(100e0 * count(*) FILTER (WHERE split = 'train')
             / (SELECT count(*) FROM split WHERE split = 'train'), 2) AS train_percent,
       round(100e0 * count(*) FILTER (WHERE split = 'test')
             / (SELECT count(*) FROM split WHERE split = 'test'), 2) AS test_percent
FROM split GROUP BY primary_category""")
def class_share_by_split(spark, sf):
    return split_parity(split_keys(spark, sf))


OVERLAPPING_SQL = """
parts AS (
  SELECT doc_id, 'train' AS split FROM documents
  UNION ALL SELECT doc_id, 'val' FROM labels
  UNION ALL SELECT vec_id, 'test' FROM embeddings)"""


@registered(f"""
WITH {OVERLAPPING_SQL},
pairs AS (SELECT a.split AS x, b.split AS y, a.doc_id
          FROM (SELECT DISTINCT * FROM parts) a JOIN (SELECT DISTINCT * FROM parts) b
               ON a.doc_id = b.doc_id AND a.split < b.split)
SELECT count(*) AS shared FROM pairs""")
def split_overlap(spark, sf):
    part = lambda name, column, split: read_table(spark, sf, name).select(
        F.col(column).alias("doc_id"), F.lit(split).alias("split")
    )
    parts = part("documents", "doc_id", "train").unionByName(
        part("labels", "doc_id", "val")).unionByName(part("embeddings", "vec_id", "test"))
    return audit.split_overlap(parts, "doc_id").withColumn("shared", F.col("shared").cast("bigint"))


# --- Benchmarks -----------------------------------------------------------------------


@registered(f"WITH {q.TEST_QUERIES}, {q.SAME_CATEGORY} SELECT qid, doc_id, rel FROM qrels")
def judgments_same_category(spark, sf):
    return same_category(keys(spark, sf), test_queries(spark, sf))


GRADED_QUERIES = f"""
{q.SPLIT},
asked AS (SELECT complaint_id, primary_category, original_issue FROM split WHERE split = 'test'
          ORDER BY md5('42|' || complaint_id), complaint_id LIMIT {fixed.GRADED_QUERIES})"""
GRADED_SQL = """
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
  WHERE r <= 20)"""


@registered(f"WITH {GRADED_QUERIES}, {GRADED_SQL} SELECT qid, doc_id, rel FROM qrels")
def judgments_graded(spark, sf):
    test = split_keys(spark, sf).where("split = 'test'")
    return graded(keys(spark, sf), ranking.sample_rows(test, "complaint_id", fixed.GRADED_QUERIES))


def _benchmark_sql(part: str) -> str:
    return f"""
WITH {q.CORPUS}, {q.TEST_QUERIES}, {q.SAME_CATEGORY}
SELECT 'document' AS part, complaint_id AS id, cleaned_text AS text, CAST(NULL AS VARCHAR) AS doc_id,
       CAST(NULL AS BIGINT) AS rel FROM corpus
UNION ALL
SELECT 'query', a.complaint_id, c.cleaned_text, NULL, NULL
FROM asked a JOIN corpus c USING (complaint_id)
UNION ALL SELECT 'judgment', qid, NULL, doc_id, rel FROM qrels"""


@registered(_benchmark_sql("all"))
def benchmark_build(spark, sf):
    """Documents, queries and judgments as the files hold them, in one frame."""
    master = kept_corpus(spark, sf)
    test = stratified_split(master).where("split = 'test'")
    return _benchmark_frame(build_benchmark(master, test))


@registered(f"""
WITH {q.CORPUS}, {GRADED_QUERIES}, {GRADED_SQL}
SELECT 'document' AS part, complaint_id AS id, cleaned_text AS text, CAST(NULL AS VARCHAR) AS doc_id,
       CAST(NULL AS BIGINT) AS rel FROM corpus
UNION ALL
SELECT 'query', a.complaint_id, c.cleaned_text, NULL, NULL
FROM asked a JOIN corpus c USING (complaint_id)
UNION ALL SELECT 'judgment', qid, NULL, doc_id, rel FROM qrels""")
def benchmark_build_graded(spark, sf):
    master = kept_corpus(spark, sf)
    test = stratified_split(master).where("split = 'test'")
    return _benchmark_frame(build_graded_benchmark(master, test))


def _benchmark_frame(benchmark):
    none = lambda t: F.lit(None).cast(t)
    texts = lambda df, part: df.select(
        F.lit(part).alias("part"), F.col("complaint_id").alias("id"),
        F.col("cleaned_text").alias("text"), none("string").alias("doc_id"),
        none("bigint").alias("rel"),
    )
    judgments = benchmark.qrels.select(
        F.lit("judgment").alias("part"), F.col("qid").alias("id"),
        none("string").alias("text"), "doc_id", "rel",
    )
    return texts(benchmark.documents, "document").unionByName(
        texts(benchmark.queries, "query")).unionByName(judgments)


@registered(f"""
WITH {GRADED_QUERIES}, {GRADED_SQL}
SELECT count(*) AS queries, sum(n)::BIGINT AS judgments, round(avg(n), 6) AS mean,
       min(n) AS min, max(n) AS max
FROM (SELECT count(*) AS n FROM qrels GROUP BY qid)""")
def judgments_per_query(spark, sf):
    test = split_keys(spark, sf).where("split = 'test'")
    qrels = graded(keys(spark, sf), ranking.sample_rows(test, "complaint_id", fixed.GRADED_QUERIES))
    return audit.judgment_summary(qrels)


@registered(f"""
WITH {q.TEST_QUERIES}, {q.SAME_CATEGORY},
known AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents),
judged AS (
  SELECT qid, doc_id FROM qrels
  UNION ALL SELECT 'absent', complaint_id FROM asked
  UNION ALL SELECT complaint_id, 'absent-' || n FROM asked, range(3) t(n))
SELECT 'query' AS side, count(*) AS n FROM judged
WHERE qid NOT IN (SELECT complaint_id FROM asked)
UNION ALL SELECT 'document', count(*) FROM judged WHERE doc_id NOT IN (SELECT doc_id FROM known)""")
def judgment_references(spark, sf):
    """Judgments of the benchmark, and some whose query or document is not there."""
    asked = test_queries(spark, sf)
    known = keys(spark, sf).select(F.col("complaint_id").alias("doc_id"))
    qid = F.col("complaint_id")
    numbers = F.explode(F.array(*map(F.lit, range(3)))).alias("n")
    absent = asked.select(qid.alias("qid"), numbers).select("qid", F.concat(F.lit("absent-"), "n").alias("doc_id"))
    qrels = (
        same_category(keys(spark, sf), asked).select("qid", "doc_id")
        .unionByName(asked.select(F.lit("absent").alias("qid"), qid.alias("doc_id")))
        .unionByName(absent)
    )
    return audit.missing_references(qrels, asked.select(F.col("complaint_id").alias("qid")), known)


# --- Gates ----------------------------------------------------------------------------

_PII = [("emails", fixed.EMAIL_PATTERN), ("phones", fixed.PHONE_PATTERN), ("cards", fixed.CARD_PATTERN)]


@registered(f"""
WITH {q.CORPUS}, {q.TEST_QUERIES}, {q.SAME_CATEGORY},
gates AS (
  SELECT 'missing_columns' AS gate, 0 AS value
  UNION ALL SELECT 'nulls', 0
  UNION ALL SELECT 'corpus_rows', count(*) FROM corpus
  {' '.join(f"UNION ALL SELECT '{n}', count(*) FROM corpus WHERE regexp_matches(cleaned_text, '{p}')"
            for n, p in _PII)}
  UNION ALL SELECT 'duplicate_texts', count(*) - count(DISTINCT cleaned_text) FROM corpus
  UNION ALL SELECT 'duplicate_ids', count(*) - count(DISTINCT complaint_id) FROM corpus
  UNION ALL SELECT 'smallest_class', min(n) FROM
    (SELECT count(*) AS n FROM corpus GROUP BY primary_category)
  UNION ALL SELECT 'split_overlap', 0
  UNION ALL SELECT 'split_rows', count(*) FROM split
  UNION ALL SELECT 'queries', count(*) FROM asked
  UNION ALL SELECT 'judgments', count(*) FROM qrels
  UNION ALL SELECT 'low_judgments', count(*) FROM qrels WHERE rel < 1
  UNION ALL SELECT 'label_differences', count(*) FROM (
    SELECT DISTINCT primary_category FROM corpus WHERE primary_category NOT IN {tuple(LANGS)})
  UNION ALL SELECT 'classes_not_in_splits', 3 * {len(LANGS)} - count(*) FROM (
    SELECT DISTINCT primary_category, split FROM split)
  UNION ALL SELECT 'unjudged_queries', count(*) FROM asked WHERE complaint_id NOT IN (SELECT qid FROM qrels)
  UNION ALL SELECT 'unknown_queries', 0
  UNION ALL SELECT 'unknown_documents', 0)
SELECT gate, CASE WHEN CASE gate
    WHEN 'corpus_rows' THEN value >= 4000 WHEN 'smallest_class' THEN value >= 500
    WHEN 'queries' THEN value = 350 WHEN 'judgments' THEN value > 0
    WHEN 'split_rows' THEN value = (SELECT count(*) FROM corpus) ELSE value = 0 END
  THEN 'pass' ELSE 'fail' END AS status, CAST(value AS BIGINT) AS value
FROM gates""")
def quality_gates(spark, sf):
    master = kept_corpus(spark, sf)
    split = stratified_split(master.select("complaint_id", "primary_category"))
    asked = test_queries(spark, sf)
    return audit.validate(
        master, split, asked.select(F.col("complaint_id").alias("qid")),
        same_category(keys(spark, sf), asked), classes=LANGS,
    )


@registered(f"""
WITH {q.CORPUS}, found AS (SELECT DISTINCT {rules_sql('cleaned_text')} AS category FROM corpus)
SELECT category, 'unexpected' AS problem FROM (
  SELECT category FROM found EXCEPT SELECT unnest({fixed.SIX_CLASSES}))
UNION ALL
SELECT category, 'missing' FROM (SELECT unnest({fixed.SIX_CLASSES}) AS category EXCEPT SELECT category FROM found)""")
def legacy_label_difference(spark, sf):
    """Categories the keyword rules give, against the six of the legacy corpus."""
    found = corpus(spark, sf).select(text.taxonomy(F.col("cleaned_text")).alias("category"))
    return audit.label_difference(found, "category", fixed.SIX_CLASSES)


@registered(f"""
WITH {q.CORPUS}
SELECT primary_category, count(*) AS n, count(*) >= 100 AS enough,
       (SELECT count(*) FROM corpus) >= 200 AS corpus_enough FROM corpus GROUP BY primary_category""")
def class_thresholds(spark, sf):
    rows = keys(spark, sf)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.groupBy("primary_category").agg(F.count(F.lit(1)).alias("n")).select(
        "primary_category", "n", (F.col("n") >= 100).alias("enough"),
        (total >= 200).alias("corpus_enough"),
    )


# --- Predictions against labels ---------------------------------------------------------

PREDICTED_SQL = """
predicted AS (SELECT CAST(quality AS VARCHAR) AS label,
                     CASE WHEN toxic = 1 THEN '0' WHEN n_chars > 2000 THEN '2' ELSE '1' END AS prediction
              FROM labels JOIN documents USING (doc_id))"""


def _predicted(spark, sf):
    joined = read_table(spark, sf, "labels").join(
        read_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return joined.select(
        F.col("quality").cast("string").alias("label"),
        F.when(F.col("toxic") == 1, "0").when(F.col("n_chars") > 2000, "2").otherwise("1")
        .alias("prediction"),
    )


@registered(f"""
WITH {PREDICTED_SQL}
SELECT label, prediction, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS row_share
FROM predicted GROUP BY label, prediction""")
def confusion_matrix(spark, sf):
    return metrics.confusion(_predicted(spark, sf)).withColumn("row_share", F.round("row_share", 6))


REPORT_SQL = f"""
{PREDICTED_SQL},
classes AS (SELECT label AS class FROM predicted UNION SELECT prediction FROM predicted),
counts AS (
  SELECT class,
         (SELECT count(*) FROM predicted WHERE label = class AND prediction = class) AS hits,
         (SELECT count(*) FROM predicted WHERE label = class) AS support,
         (SELECT count(*) FROM predicted WHERE prediction = class) AS guessed FROM classes),
pr AS (SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0e0 END AS p,
              CASE WHEN support > 0 THEN hits / support ELSE 0e0 END AS r FROM counts),
report AS (SELECT class, p AS precision, r AS recall,
                  CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END AS f1, support, hits FROM pr)"""


@registered(f"""
WITH {REPORT_SQL}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM report""")
def class_report(spark, sf):
    report = metrics.class_report(metrics.confusion(_predicted(spark, sf)))
    return report.select(
        "class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


@registered(f"""
WITH {REPORT_SQL}
SELECT round(sum(hits) / sum(support), 4) AS accuracy,
       {', '.join(f"round(avg({m}), 4) AS macro_{m}" for m in ("precision", "recall", "f1"))},
       {', '.join(f"round(sum({m} * support) / sum(support), 4) AS weighted_{m}"
                  for m in ("precision", "recall", "f1"))}
FROM report""")
def classification_summary(spark, sf):
    return metrics.summary(metrics.class_report(metrics.confusion(_predicted(spark, sf))))


@registered("""
WITH t AS (SELECT lang, round(avg(n_chars), 4) AS mean_chars, round(max(n_chars)::DOUBLE, 4) AS max_chars
           FROM documents GROUP BY lang)
SELECT lang, 'mean_chars' AS metric, mean_chars AS score FROM t
UNION ALL SELECT lang, 'max_chars', max_chars FROM t""")
def melt_metrics(spark, sf):
    table = read_table(spark, sf, "documents").groupBy("lang").agg(
        F.round(F.avg("n_chars"), 4).alias("mean_chars"),
        F.max("n_chars").cast("double").alias("max_chars"),
    )
    return metrics.melted(table, ["lang"], ["mean_chars", "max_chars"])
