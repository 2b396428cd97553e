"""Pieces of the SQL that checks the queries."""

from __future__ import annotations

from casegrain import fixed_values as fixed

BLANKS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
MASKS = {
    "email": (fixed.EMAIL_PATTERN, fixed.EMAIL_TOKEN),
    "phone": (fixed.PHONE_PATTERN, fixed.PHONE_TOKEN),
    "card": (fixed.CARD_PATTERN, fixed.CARD_TOKEN),
    "wallet": (fixed.WALLET_PATTERN, fixed.WALLET_TOKEN),
    "url": (fixed.URL_PATTERN, fixed.URL_TOKEN),
    "ip": (fixed.IP_PATTERN, fixed.IP_TOKEN),
}


def masked(x: str, *names: str) -> str:
    for name in names:
        pattern, token = MASKS[name]
        x = f"regexp_replace({x}, '{pattern}', '{token}', 'g')"
    return x


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANKS}+', ' ', 'g'))"


def cleaned(x: str) -> str:
    return collapsed(masked(f"coalesce({x}, '')", *MASKS))


def words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


STOP_LIST = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"


def content(x: str) -> str:
    return (
        f"list_filter({tokens(x)}, lambda w: length(w) > 1 AND NOT list_contains({STOP_LIST}, w))"
    )


def terms(words_column: str = "w") -> str:
    w = words_column
    return (
        f"list_concat({w}, list_transform(range(1, len({w})),"
        f" lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    )


CORPUS = f"""
corpus0 AS (
  SELECT CAST(doc_id AS VARCHAR) AS complaint_id, source, lang AS primary_category,
         source AS original_issue, text AS raw_text, {cleaned('text')} AS cleaned_text
  FROM documents),
corpus AS (SELECT *, {words('cleaned_text')} AS word_count FROM corpus0)"""

KEYS = """
keys AS (SELECT CAST(doc_id AS VARCHAR) AS complaint_id, lang AS primary_category,
                source AS original_issue, source FROM documents)"""

SPLIT = KEYS + """,
placed AS (
  SELECT *, count(*) OVER (PARTITION BY primary_category) AS n,
         row_number() OVER (PARTITION BY primary_category
                            ORDER BY md5('42|' || complaint_id), complaint_id) AS r
  FROM keys),
split AS (
  SELECT complaint_id, primary_category, original_issue, source,
         CASE WHEN r <= n * 70 // 100 THEN 'train'
              WHEN r <= n * 70 // 100 + (n - n * 70 // 100) // 2 THEN 'val'
              ELSE 'test' END AS split
  FROM placed)"""

TEST_QUERIES = SPLIT + """,
asked AS (
  SELECT complaint_id, primary_category, original_issue FROM (
    SELECT *, row_number() OVER (PARTITION BY primary_category
                                 ORDER BY md5('42|' || complaint_id), complaint_id) AS r
    FROM split WHERE split = 'test') WHERE r <= 50)"""

SAME_CATEGORY = """
qrels AS (
  SELECT qid, doc_id, CAST(1 AS BIGINT) AS rel FROM (
    SELECT a.complaint_id AS qid, k.complaint_id AS doc_id,
           row_number() OVER (PARTITION BY a.complaint_id ORDER BY k.complaint_id) AS r
    FROM asked a JOIN keys k USING (primary_category)
    WHERE a.complaint_id <> k.complaint_id) WHERE r <= 30)"""

CASES = f"""
cases AS (SELECT doc_id, {cleaned('text')} AS text, lang AS category, source FROM documents)"""


def ranked(scores: str, k: int, order: str = "score DESC, doc_id") -> str:
    return f"""(
  SELECT qid, rank, doc_id, score FROM (
    SELECT qid, doc_id, score,
           row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank
    FROM {scores}) WHERE rank <= {k})"""


def bm25(docs: str, queries: str, name: str = "bm25", k: int = 10, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs ``{name}_scores`` and ``{name}`` over docs(doc_id, text), queries(qid, text)."""
    return f"""
{name}_tokens AS (SELECT doc_id, {tokens('text')} AS toks FROM {docs}),
{name}_docs AS (SELECT doc_id, len(toks) AS len FROM {name}_tokens),
{name}_stats AS (SELECT count(*) AS n, CAST(sum(len) AS DOUBLE) / count(*) AS avg_len
                 FROM {name}_docs),
{name}_postings AS (
  SELECT term, doc_id, count(*) AS tf
  FROM (SELECT doc_id, unnest(toks) AS term FROM {name}_tokens) GROUP BY ALL),
{name}_terms AS (
  SELECT term, df, ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf
  FROM (SELECT term, count(*) AS df FROM {name}_postings GROUP BY term), {name}_stats),
{name}_asked AS (SELECT qid, unnest({tokens('text')}) AS term FROM {queries}),
{name}_scores AS (
  SELECT qid, doc_id,
         round(sum(idf * tf * ({k1}e0 + 1e0)
                   / (tf + {k1}e0 * (1e0 - {b}e0 + {b}e0 * len / avg_len))), 6) AS score
  FROM {name}_asked JOIN {name}_terms USING (term) JOIN {name}_postings USING (term)
       JOIN {name}_docs USING (doc_id), {name}_stats
  GROUP BY qid, doc_id),
{name} AS {ranked(name + '_scores', k)}"""


def tfidf_fit(docs: str, name: str = "tfidf", features: int = 10000, min_df: int = 2) -> str:
    """CTEs ``{name}_tf`` and ``{name}_voc`` over docs(doc_id, text)."""
    return f"""
{name}_words AS (SELECT doc_id, {content('text')} AS w FROM {docs}),
{name}_tf AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({terms()}) AS term FROM {name}_words) GROUP BY ALL),
{name}_voc AS (
  SELECT term, df, ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf
  FROM (SELECT term, sum(tf) AS freq, count(*) AS df FROM {name}_tf GROUP BY term
        HAVING count(*) >= {min_df} ORDER BY freq DESC, term LIMIT {features}),
       (SELECT count(*) AS n FROM {docs}))"""


def tfidf_vectors(tf: str, voc: str, name: str, key: str = "doc_id", sublinear: bool = True) -> str:
    """CTE ``{name}(key, term, weight)``: unit rows."""
    weight = "(1e0 + ln(tf)) * idf" if sublinear else "tf * idf"
    return f"""
{name}_raw AS (SELECT {key}, term, {weight} AS w FROM {tf} JOIN {voc} USING (term)),
{name}_norm AS (SELECT {key}, sqrt(sum(w * w)) AS nm FROM {name}_raw GROUP BY {key}),
{name} AS (SELECT {key}, term, w / nm AS weight FROM {name}_raw JOIN {name}_norm USING ({key}))"""


def query_tf(queries: str, name: str) -> str:
    return f"""
{name}_words AS (SELECT qid, {content('text')} AS w FROM {queries}),
{name} AS (
  SELECT qid, term, count(*) AS tf
  FROM (SELECT qid, unnest({terms()}) AS term FROM {name}_words) GROUP BY ALL)"""


def tfidf_search(docs: str, queries: str, name: str = "cosine", k: int = 10) -> str:
    return ",".join([
        tfidf_fit(docs, f"{name}_fit", min_df=1),
        tfidf_vectors(f"{name}_fit_tf", f"{name}_fit_voc", f"{name}_d"),
        query_tf(queries, f"{name}_qtf"),
        tfidf_vectors(f"{name}_qtf", f"{name}_fit_voc", f"{name}_q", "qid"),
        f"""
{name}_scores AS (
  SELECT qid, doc_id, round(sum(q.weight * d.weight), 6) AS score
  FROM {name}_q q JOIN {name}_d d USING (term) GROUP BY qid, doc_id
  HAVING round(sum(q.weight * d.weight), 6) > 0),
{name} AS {ranked(name + '_scores', k)}""",
    ])


def unit(v: str) -> str:
    v = f"CAST({v} AS DOUBLE[])"
    return (
        f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
    )


def dense(docs: str, queries: str, name: str = "dense", k: int = 10) -> str:
    """docs(doc_id, vector), queries(qid, vector)."""
    return f"""
{name}_scores AS (
  SELECT qid, doc_id, round(list_inner_product(q.vector, d.vector), 6) AS score
  FROM {queries} q, {docs} d),
{name} AS {ranked(name + '_scores', k)}"""


def fused(sparse: str, dense_list: str, name: str = "fused", k: int = 10) -> str:
    return f"""
{name}_lists AS (
  SELECT qid, doc_id, max(s) AS s, max(d) AS d FROM (
    SELECT qid, doc_id, rank AS s, NULL AS d FROM {sparse} WHERE rank <= 50
    UNION ALL SELECT qid, doc_id, NULL, rank FROM {dense_list} WHERE rank <= 50)
  GROUP BY qid, doc_id),
{name}_scores AS (
  SELECT *, coalesce(1e0 / (60 + s), 0e0) + coalesce(1e0 / (60 + d), 0e0) AS raw
  FROM {name}_lists),
{name} AS (
  SELECT qid, rank, doc_id, round(raw, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, s NULLS LAST, d) AS rank
    FROM {name}_scores) WHERE rank <= {k})"""


def query_metrics(rankings: str, qrels: str, name: str = "scored") -> str:
    """CTE ``{name}`` per (retriever, qid) over rankings(retriever, qid, rank, doc_id)."""
    gain = "(pow(2e0, rel) - 1e0) / log2(rank + 1e0)"
    hit = lambda k: f"rel > 0 AND rank <= {k}"
    total = lambda value, k: f"coalesce(sum({value}) FILTER (WHERE {hit(k)}), 0e0)"
    return f"""
{name}_hits AS (
  SELECT r.retriever, r.qid, r.rank, coalesce(j.rel, 0) AS rel,
         sum(CASE WHEN coalesce(j.rel, 0) > 0 THEN 1 ELSE 0 END)
           OVER (PARTITION BY r.retriever, r.qid ORDER BY r.rank) AS hits
  FROM {rankings} r LEFT JOIN {qrels} j ON r.qid = j.qid AND r.doc_id = j.doc_id),
{name}_sums AS (
  SELECT retriever, qid, {total(gain, 5)} AS dcg_5, {total(gain, 10)} AS dcg_10,
         coalesce(max(1e0 / rank) FILTER (WHERE {hit(10)}), 0e0) AS mrr_10,
         {total('hits / CAST(rank AS DOUBLE)', 10)} AS ap_10,
         {', '.join(f"{total('1e0', k)} AS hits_{k}" for k in (1, 5, 10, 20))}
  FROM {name}_hits GROUP BY retriever, qid),
{name}_ideal AS (
  SELECT qid, count(*) AS judgments,
         coalesce(sum({gain}) FILTER (WHERE rel > 0 AND rank <= 5), 0e0) AS ideal_5,
         coalesce(sum({gain}) FILTER (WHERE rel > 0 AND rank <= 10), 0e0) AS ideal_10
  FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS rank
        FROM {qrels}) GROUP BY qid),
{name} AS (
  SELECT retriever, qid,
         CASE WHEN ideal_10 > 0 THEN dcg_10 / ideal_10 ELSE 0e0 END AS ndcg_10,
         CASE WHEN ideal_5 > 0 THEN dcg_5 / ideal_5 ELSE 0e0 END AS ndcg_5,
         mrr_10, coalesce(ap_10 / least(judgments, 10), 0e0) AS map_10,
         {', '.join(f"coalesce(hits_{k} / judgments, 0e0) AS recall_{k}" for k in (1, 5, 10, 20))},
         {', '.join(f"hits_{k} / {k}e0 AS precision_{k}" for k in (1, 5, 10))}
  FROM {name}_sums LEFT JOIN {name}_ideal USING (qid))"""


METRICS = ["ndcg_10", "ndcg_5", "mrr_10", "map_10", "recall_1", "recall_5", "recall_10",
           "recall_20", "precision_10"]


def mean_metrics(names: list[str], queries: str, scored: str = "scored") -> str:
    means = ", ".join(f"round(avg(coalesce({m}, 0e0)), 4) AS {m}" for m in METRICS)
    values = ", ".join(f"('{n}')" for n in names)
    return f"""
SELECT n.retriever, {means}
FROM (SELECT DISTINCT qid FROM {queries}) q
CROSS JOIN (VALUES {values}) n(retriever)
LEFT JOIN {scored} s ON s.qid = q.qid AND s.retriever = n.retriever
GROUP BY n.retriever"""
