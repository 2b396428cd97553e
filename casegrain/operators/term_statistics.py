"""Terms that tell classes apart: chi-square and log odds with an informative prior."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.operators.features import counted_terms, word_table
from casegrain.operators.ranking import first_per_group
from casegrain.operators.terms import exploded
from casegrain.workspace import written

PRIOR = 1000.0
LEAST_COUNT = 5


def class_term_counts(
    docs: DataFrame, label: str, text_column: str, stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> tuple[DataFrame, DataFrame]:
    """``(label, term, freq, df)``, written, and ``(label, n_docs, n_terms)`` per class.

    Terms are counted inside each row and in the map tasks first, so a frequent term or a
    large class sends one row per task.
    """
    words = written(word_table(docs, text_column, [label], stop_words), "statistics-words")
    counts = written(
        exploded(counted_terms(words), [label], "terms", "_t")
        .groupBy(label, F.col("_t.term").alias("term"))
        .agg(F.sum("_t.tf").alias("freq"), F.count(F.lit(1)).alias("df")),
        "class-terms",
    )
    docs_of = words.groupBy(label).agg(F.count(F.lit(1)).alias("n_docs"))
    terms_of = counts.groupBy(label).agg(F.sum("freq").alias("n_terms"))
    sizes = docs_of.join(terms_of, docs_of[label].eqNullSafe(terms_of[label]), "left").select(
        docs_of[label], "n_docs", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    return counts, written(sizes, "class-sizes")


def _with_rest(counts: DataFrame, sizes: DataFrame, label: str, least: int) -> DataFrame:
    """Each class and term with the sums over all classes, of terms with enough occurrences."""
    totals = counts.groupBy("term").agg(F.sum("freq").alias("all_freq"), F.sum("df").alias("all_df"))
    whole = sizes.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_terms").alias("all_terms")).first()
    named = counts.join(totals.where(F.col("all_freq") >= least), "term")
    # One row per class: far below any limit, but counted by nobody, so Spark decides how to join it.
    return named.join(sizes, named[label].eqNullSafe(sizes[label])).select(
        named[label], "term", "freq", "df", "all_freq", "all_df", "n_docs", "n_terms",
        F.lit(whole["all_docs"]).alias("all_docs"), F.lit(whole["all_terms"]).alias("all_terms"))


def _first(scored: DataFrame, label: str, score: str, n: int) -> DataFrame:
    ordered = scored.withColumn(score, F.round(score, 6))
    best = first_per_group(ordered, [label], [F.col(score).desc(), F.col("term")], n, rank="rank")
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def log_odds_terms(
    docs: DataFrame, label: str, text_column: str = "cleaned_text", n: int = fixed.CLASS_TERMS,
    prior: float = PRIOR, least: int = LEAST_COUNT, stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> DataFrame:
    """The ``n`` terms of each class with the highest z-score ``(label, rank, term, log_odds, z)``.

    The log odds of a term in the class against all others, with a Dirichlet prior that gives
    each term its share of ``prior`` by its frequency in the whole corpus, divided by the
    standard deviation. Terms with fewer than ``least`` occurrences are left out.
    """
    counts, sizes = class_term_counts(docs, label, text_column, stop_words)
    rows = _with_rest(counts, sizes, label, least).withColumn(
        "share", prior * F.col("all_freq") / F.col("all_terms"))
    one = F.col("freq") + F.col("share")
    other = F.col("all_freq") - F.col("freq") + F.col("share")
    rest = F.col("all_terms") - F.col("n_terms")
    odds = F.ln(one / (F.col("n_terms") + prior - one)) - F.ln(other / (rest + prior - other))
    scored = rows.withColumn("log_odds", odds).withColumn("z", F.col("log_odds") / F.sqrt(1 / one + 1 / other))
    return _first(scored, label, "z", n).select(label, "rank", "term", F.round("log_odds", 6).alias("log_odds"), "z")


def chi_square_terms(
    docs: DataFrame, label: str, text_column: str = "cleaned_text", n: int = fixed.CLASS_TERMS,
    least: int = LEAST_COUNT, stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> DataFrame:
    """The ``n`` terms of each class whose presence in a document depends most on the class.

    ``(label, rank, term, df, chi_square)``: only terms that are more frequent in the class than
    outside it. Terms in every document and classes that hold all documents have none.
    """
    counts, sizes = class_term_counts(docs, label, text_column, stop_words)
    number = lambda c: F.col(c).cast("double")
    rows = _with_rest(counts, sizes, label, least)
    a, b = number("df"), number("all_df") - number("df")
    c, d = number("n_docs") - a, number("all_docs") - number("n_docs") - b
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    gap = a * d - b * c
    scored = rows.where((gap > 0) & (spread > 0)).withColumn("chi_square", number("all_docs") * gap * gap / spread)
    return _first(scored, label, "chi_square", n).select(label, "rank", "term", "df", "chi_square")
