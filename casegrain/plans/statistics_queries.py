"""Registered queries: significance of differences, terms of classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.functions import text
from casegrain.operators.significance import (
    EXACT_BELOW,
    PRIME,
    REPLICATES,
    bootstrap_means,
    mcnemar,
    poisson_bounds,
    replicate_factors,
)
from casegrain.operators.summaries import answered, merged, summarised
from casegrain.operators.term_statistics import LEAST_COUNT, PRIOR, chi_square_terms, log_odds_terms
from casegrain.plans import sql as q
from casegrain.plans.catalog import registered
from casegrain.plans.standins import corpus, documents
from casegrain.plans.text_queries import rules_sql
from casegrain.workspace import written

# Two small classifiers of the language, by words only or by letters as well.
BY_WORDS = [
    ("fr", [r"\bles\b", r"\bque\b"]),
    ("de", [r"\bund\b", r"\bnicht\b"]),
    ("es", [r"\blos\b", r"\bpor\b"]),
]
BY_LETTERS = [("de", ["ß", "ü"]), ("es", ["ñ", "ó"]), ("fr", ["è", "ê"])]

GUESSED = f"""
guessed AS (
  SELECT doc_id, source, lang, {rules_sql('text', BY_WORDS, 'en')} AS by_words,
         {rules_sql('text', BY_LETTERS, 'en')} AS by_letters
  FROM documents)"""


def _guessed(spark, sf):
    return documents(spark, sf, "doc_id", "source", "lang", "text").select(
        "doc_id", "source", "lang",
        text.taxonomy(F.col("text"), BY_WORDS, "en").alias("by_words"),
        text.taxonomy(F.col("text"), BY_LETTERS, "en").alias("by_letters"),
    )


_RIGHT = "coalesce({0} = lang, false)"
_ONE, _OTHER = _RIGHT.format("by_words"), _RIGHT.format("by_letters")


@registered(f"""
WITH {GUESSED},
counts AS (
  SELECT source, count_if({_ONE} AND {_OTHER})::BIGINT AS both_right, count_if({_ONE} AND NOT {_OTHER})::BIGINT AS only_first,
         count_if(NOT {_ONE} AND {_OTHER})::BIGINT AS only_second,
         count_if(NOT {_ONE} AND NOT {_OTHER})::BIGINT AS none_right
  FROM guessed WHERE lang IS NOT NULL GROUP BY source),
tested AS (
  SELECT *, only_first + only_second AS apart,
         greatest(abs(only_first - only_second) - 1, 0) AS gap FROM counts)
SELECT source, both_right, only_first, only_second, none_right,
       CASE WHEN apart > 0 THEN round(gap * gap / apart::DOUBLE, 6) END AS statistic,
       CASE WHEN apart < {EXACT_BELOW} THEN round(least(1e0, 2e0 * list_sum(list_transform(
         range(0, least(only_first, only_second) + 1),
         lambda i: exp(lgamma(apart + 1) - lgamma(i + 1) - lgamma(apart - i + 1)))) / pow(2e0, apart)), 6) END
         AS p_exact
FROM tested""")
def mcnemar_test(spark, sf):
    """Per source: do two classifiers of the language differ in more than chance?"""
    tested = mcnemar(_guessed(spark, sf), "lang", "by_words", "by_letters", ["source"])
    few = F.col("only_first") + F.col("only_second") < EXACT_BELOW
    return tested.select(
        "source", "both_right", "only_first", "only_second", "none_right", F.round("statistic", 6).alias("statistic"),
        F.when(few, F.round("p_value", 6)).alias("p_exact"),
    )


_FACTORS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(replicate_factors(REPLICATES)))
_WEIGHT = " + ".join(f"(u >= {bound})::INTEGER" for bound in poisson_bounds())


@registered(f"""
WITH {GUESSED},
rows AS (
  SELECT lang, ('0x' || substr(md5('42|' || doc_id), 1, 7))::BIGINT AS h,
         CASE WHEN by_words = lang THEN 1e0 ELSE 0e0 END AS value
  FROM guessed WHERE lang IS NOT NULL),
drawn AS (
  SELECT lang, r, value, {_WEIGHT} AS w
  FROM (SELECT lang, value, r, (h * a + b) % {PRIME} AS u
        FROM rows, (VALUES {_FACTORS}) f(r, a, b))),
means AS (
  SELECT lang, r, sum(w * value) / sum(w) AS mean FROM drawn GROUP BY lang, r HAVING sum(w) > 0)
SELECT lang, any_value(n) AS n, any_value(whole) AS accuracy, round(quantile_cont(mean, 0.025), 6) AS low,
       round(quantile_cont(mean, 0.975), 6) AS high
FROM means JOIN (SELECT lang, count(*) AS n, round(avg(value), 6) AS whole FROM rows GROUP BY lang) USING (lang)
GROUP BY lang""")
def bootstrap_accuracy(spark, sf):
    """Accuracy of a classifier per language with its 95 % bootstrap interval."""
    right = F.when(F.col("lang").isNotNull(), (F.col("by_words") == F.col("lang")).cast("double"))
    intervals = bootstrap_means(_guessed(spark, sf).withColumn("right", right), "doc_id", "right", "lang")
    six = lambda c, name=None: F.round(c, 6).alias(name or c)
    return intervals.select("lang", "n", six("mean", "accuracy"), six("low"), six("high"))


_COUNTED = f"""
WITH {q.CORPUS},
words AS (SELECT primary_category, {q.content('cleaned_text')} AS w FROM corpus),
in_docs AS (
  SELECT primary_category, term, count(*) AS tf
  FROM (SELECT row_number() OVER () AS d, primary_category, {q.terms()} AS ts FROM words),
       unnest(ts) AS u(term)
  GROUP BY d, primary_category, term),
counts AS (SELECT primary_category, term, sum(tf) AS freq, count(*) AS df FROM in_docs GROUP BY ALL),
sizes AS (
  SELECT primary_category, n_docs, n_terms FROM
    (SELECT primary_category, count(*) AS n_docs FROM words GROUP BY primary_category)
    JOIN (SELECT primary_category, sum(freq) AS n_terms FROM counts GROUP BY primary_category)
    USING (primary_category)),
rows AS (
  SELECT c.primary_category, c.term, c.freq::DOUBLE AS freq, c.df, all_freq::DOUBLE AS all_freq,
         all_df::DOUBLE AS all_df, n_docs::DOUBLE AS n_docs, n_terms::DOUBLE AS n_terms,
         (SELECT sum(n_docs) FROM sizes)::DOUBLE AS all_docs, (SELECT sum(n_terms) FROM sizes)::DOUBLE AS all_terms
  FROM counts c JOIN (SELECT term, sum(freq) AS all_freq, sum(df) AS all_df FROM counts GROUP BY term
                      HAVING sum(freq) >= {LEAST_COUNT}) t ON c.term = t.term
  JOIN sizes s ON s.primary_category = c.primary_category)"""


@registered(f"""{_COUNTED},
shares AS (SELECT *, {PRIOR} * all_freq / all_terms AS share FROM rows),
odds AS (
  SELECT primary_category, term, freq + share AS one, all_freq - freq + share AS other,
         ln((freq + share) / (n_terms + {PRIOR} - freq - share))
         - ln((all_freq - freq + share) / (all_terms - n_terms + {PRIOR} - all_freq + freq - share)) AS log_odds
  FROM shares),
scored AS (
  SELECT primary_category, term, round(log_odds, 6) AS log_odds, round(log_odds / sqrt(1 / one + 1 / other), 6) AS z
  FROM odds)
SELECT primary_category, rank, term, log_odds, z FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY z DESC, term) AS rank FROM scored)
WHERE rank <= 20""")
def log_odds_class_terms(spark, sf):
    return log_odds_terms(corpus(spark, sf), "primary_category", n=20)


@registered(f"""{_COUNTED},
cells AS (
  SELECT primary_category, term, df, all_docs, df::DOUBLE AS a, all_df - df AS b, n_docs - df AS c,
         all_docs - n_docs - all_df + df AS d FROM rows),
scored AS (
  SELECT primary_category, term, df,
         round(all_docs * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) AS chi_square
  FROM cells WHERE a * d > b * c AND (a + b) * (c + d) * (a + c) * (b + d) > 0)
SELECT primary_category, rank, term, df, chi_square FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY chi_square DESC, term) AS rank FROM scored)
WHERE rank <= 20""")
def chi_square_class_terms(spark, sf):
    return chi_square_terms(corpus(spark, sf), "primary_category", n=20)


@registered()
def merged_summaries(spark, sf):
    """Word-count quantiles and vocabulary per language, from summaries of each source and language."""
    parts = written(summarised(documents(spark, sf, "source", "lang", "text"), ["source", "lang"]), "summaries")
    return answered(merged(parts, ["lang"]))
