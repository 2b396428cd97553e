"""The training-data operators applied to whole tables, with SQL where it can say the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from casegrain.llm import (
    collocations, edit_counts, exact_dedup, kneser_ney, mixing, packing, phrase_parsing, pii, rule_ensemble, simhash,
    spelling_variants, toxicity, url_rules,
)
from casegrain.workspace import read_table, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


@registered()
def op1_hierarchical_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(read_table(spark, sf, "documents"), with_ids=False)


@registered()
def op2_weakly_supervised_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.found_spans(read_table(spark, sf, "documents")))


_HOST = r"lower(regexp_extract(rest, '^[^/?#]*', 0))"
_FITS = " ".join(
    f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN "
    f"struct_pack(rule := '{host}{path}', verdict := '{verdict}')"
    for verdict, host, path in sorted(url_rules.RULES, key=lambda r: (-len(r[1] + r[2]), r))
)


@registered(rf"""
WITH RECURSIVE split AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), located AS (
  SELECT page_id, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query, coalesce({_HOST}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         {_HOST} || regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) || regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS node,
         html
  FROM split
), named AS (
  SELECT node AS src, unnest(list_concat(
    regexp_extract_all(html, '(?i)<link rel="canonical" href="[^":]*://([^"#]*)', 1),
    regexp_extract_all(html, '(?i)<meta http-equiv="refresh" content="0; *url=[^":]*://([^"#]*)', 1))) AS dst
  FROM located WHERE node IS NOT NULL
  UNION ALL
  SELECT node, regexp_replace(host, '{url_rules.HOST_PREFIX}', '')
    || CASE regexp_replace(path, '{url_rules.PATH_ENDING}', '') WHEN '' THEN '/'
       ELSE regexp_replace(path, '{url_rules.PATH_ENDING}', '') END
    || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END
  FROM (SELECT *, list_filter(string_split(query, '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^{url_rules.TRACKING}(?:=|$)')) AS kept FROM located)
  WHERE node IS NOT NULL
), edges AS (
  SELECT src, dst FROM named WHERE src <> dst UNION SELECT dst, src FROM named WHERE src <> dst
), reach AS (
  SELECT src AS node, src AS alias FROM edges
  UNION SELECT reach.node, edges.dst FROM reach JOIN edges ON reach.alias = edges.src
), judged_alias AS (
  SELECT node, regexp_extract(alias, '^[^/?#]*', 0) AS host,
         regexp_extract(alias, '^[^/?#]*([^?#]*)', 1) AS path, alias FROM reach
), carried AS (
  SELECT node, min(alias) AS class, bool_or(coalesce((CASE {_FITS} END).verdict = 'block', false)) AS blocked
  FROM judged_alias GROUP BY node
), own AS (
  SELECT page_id, node, host, path, CASE {_FITS} END AS best FROM located
)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict, class
FROM own LEFT JOIN carried USING (node)""")
def op3_redirect_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judged(read_table(spark, sf, "pages"))


@registered()
def op4_counterfactual_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return toxicity.scored(docs, toxicity.train(docs, read_table(spark, sf, "labels")))


@registered()
def op5_simhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf, "documents"))


@registered()
def op6_kneser_ney_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    held_out = kneser_ney.held_out(F.col("doc_id"))
    model = kneser_ney.train(docs.where(~held_out))
    return kneser_ney.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )


@registered()
def op7_edit_aware_counts(spark: SparkSession, sf: str) -> DataFrame:
    trees = edit_counts.with_trees(read_table(spark, sf, "documents"))
    counted = edit_counts.after_edits(trees, edit_counts.touch_ups(F.col("text")))
    return counted.select(
        "doc_id", "n_tokens", "edited_tokens", F.char_length("text").cast("long").alias("edited_chars"),
        "encoded_chars",
    )


@registered()
def op8_locally_consistent_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_parsing.compared_with_edits(read_table(spark, sf, "documents"))


@registered(r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sources
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
         coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS used,
         sum(weight) OVER onward AS open
  FROM weighed
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY 2.0::DOUBLE * source_size / weight, source
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), levels AS (
  SELECT full_at, ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE - used) / open AS level FROM ranked
), level AS (
  SELECT coalesce(arg_min(level, full_at) FILTER (level < full_at), max(full_at)) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(weight * level, 2.0::DOUBLE * source_size) AS target,
         CASE WHEN source_size > 0 THEN least(weight * level, 2.0::DOUBLE * source_size) / source_size
              ELSE 0 END AS rate
  FROM weighed, level
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       d.size * (floor(t.rate)::BIGINT
         + CASE WHEN ('0x' || substr(md5('42|' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::UBIGINT
                     / 4294967296.0::DOUBLE < t.rate - floor(t.rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source""")
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mix = mixing.mixture(read_table(spark, sf, "documents"))
    return mix.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


@registered("""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1 AS kept,
       sha256(text) AS text_sha256
FROM hashed WINDOW same AS (PARTITION BY text)""")
def op10_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.equal_texts(read_table(spark, sf, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@registered(rf"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), counts AS (
  SELECT lang, size, phrase, count(*)::BIGINT AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2),
             lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size))
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size > 1 AND f >= 30
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest(list_transform(range(1, size - part + 2),
             lambda i: array_to_string(words[i:i + part - 1], ' '))) AS phrase
    FROM candidates, (SELECT unnest([2, 3]) AS part) WHERE part < size)
  GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(words[1:k], ' ') AS first,
         array_to_string(words[k + 1:], ' ') AS rest
  FROM candidates c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase,
       (SELECT unnest([1, 2, 3]) AS k)
  WHERE k < size AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * c.a)
), lowest AS (
  SELECT lang, phrase, a, unnest(min({{'score': score, 'k': k, 'l': l, 'r': r}})) FROM (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest)
  GROUP BY lang, phrase, a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf, "documents"))


def _crc_table() -> list[int]:
    """The crc32 of each byte, by its rule."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


@registered(f"""
WITH runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  GROUP BY doc_id, run
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT]
                  ELSE [(192 + (unicode(s) >> 6))::BIGINT, (128 + (unicode(s) & 63))::BIGINT] END))),
      lambda x, y: xor(x >> 8, list_extract({_crc_table()}, (xor(x, y) & 255) + 1)))) AS h
  FROM runs
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT)
                ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), gaps AS (
  SELECT word, p, substr(word, 1, p - 1) AS head, substr(word, p + 1) AS tail
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)
), shorter AS (
  SELECT DISTINCT g.word, w.word AS other FROM gaps g JOIN words w ON w.word = g.head || g.tail
), near AS (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT word, other FROM shorter UNION ALL SELECT other, word FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best
  FROM (SELECT near.word, other, n FROM near JOIN words ON words.word = other) GROUP BY word
), formed AS (
  SELECT words.word, n, CASE WHEN best_n >= 2 * n THEN best END AS form, coalesce(n_near, 0) AS n_near,
         CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chains AS (
  WITH RECURSIVE steps AS (
    SELECT word, form AS root FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT steps.word, formed.form FROM steps JOIN formed ON formed.word = root WHERE formed.form IS NOT NULL
  ) SELECT word, arg_max(root, n) AS root FROM (SELECT steps.word, root, n FROM steps JOIN words ON words.word = root)
  GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN chains USING (word)""")
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling_variants.vocabulary(read_table(spark, sf, "documents"), erased=spelling_variants.ERASED)
    return spelling_variants.variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


@registered()
def op13_rule_ensemble_quality(spark: SparkSession, sf: str) -> DataFrame:
    stats = written(rule_ensemble.statistics(read_table(spark, sf, "documents")), "text-statistics")
    return rule_ensemble.scored(stats, rule_ensemble.train(stats, read_table(spark, sf, "labels")))


@registered(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
