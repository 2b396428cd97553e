"""Scoring: rankings against judgments, predictions against labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.operators.scaling import is_small
from casegrain.workspace import written

# --- Rankings -------------------------------------------------------------------

METRICS = {
    "ndcg_10": "NDCG@10", "ndcg_5": "NDCG@5", "mrr_10": "MRR@10", "map_10": "MAP@10",
    "recall_1": "Recall@1", "recall_5": "Recall@5", "recall_10": "Recall@10",
    "recall_20": "Recall@20", "precision_10": "Precision@10",
}


def gain(rel: Column, rank: Column) -> Column:
    """Discounted gain of one hit."""
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def judged(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Each hit with its judgment, 0 when there is none.

    Judgments may be many times the hits: where the hits are few, the judgments are cut to
    them where they are, and only those move.
    """
    ranking = written(ranking, "hits")
    hits = ranking.select("qid", "doc_id").distinct()
    if is_small(hits):
        qrels = qrels.join(F.broadcast(hits), ["qid", "doc_id"], "left_semi")
    return ranking.join(qrels, ["qid", "doc_id"], "left").withColumn(
        "rel", F.coalesce("rel", F.lit(0))
    )


def running_hits(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relevant hits up to each rank."""
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn(
        "hits", F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).over(so_far)
    )


def ideal_order(qrels: DataFrame, depth: int) -> DataFrame:
    """The best possible first ``depth`` relevances of each query."""
    order = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    return qrels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def query_metrics(rankings: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """All metrics of every (retriever and) query that has hits."""
    keys = list(keys)
    hits = running_hits(judged(rankings, qrels), keys)
    rank, rel = F.col("rank"), F.col("rel")
    hit = lambda k: (rel > 0) & (rank <= k)
    total = lambda value, k: F.coalesce(F.sum(F.when(hit(k), value)), F.lit(0.0))
    found = hits.groupBy(*keys).agg(
        total(gain(rel, rank), 5).alias("dcg_5"),
        total(gain(rel, rank), 10).alias("dcg_10"),
        F.coalesce(F.max(F.when(hit(10), 1 / rank)), F.lit(0.0)).alias("mrr_10"),
        total(F.col("hits") / rank, 10).alias("ap_sum_10"),
        *[total(F.lit(1.0), k).alias(f"hits_{k}") for k in (1, 5, 10, 20)],
    )
    ideal = ideal_order(qrels, 10)
    best = ideal.groupBy("qid").agg(
        *[
            F.coalesce(
                F.sum(F.when((rel > 0) & (rank <= k), gain(rel, rank))), F.lit(0.0)
            ).alias(f"ideal_{k}")
            for k in (5, 10)
        ],
    )
    counts = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("judgments"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return (
        found.join(best.join(counts, "qid"), "qid", "left")
        .select(
            *keys,
            zero(share("dcg_10", "ideal_10")).alias("ndcg_10"),
            zero(share("dcg_5", "ideal_5")).alias("ndcg_5"),
            "mrr_10",
            zero(F.col("ap_sum_10") / F.least(F.col("judgments"), F.lit(10))).alias("map_10"),
            *[
                zero(F.col(f"hits_{k}") / F.col("judgments")).alias(f"recall_{k}")
                for k in (1, 5, 10, 20)
            ],
            *[(F.col(f"hits_{k}") / k).alias(f"precision_{k}") for k in (1, 5, 10)],
        )
    )


def evaluate(
    rankings: Mapping[str, DataFrame], qrels: DataFrame, queries: DataFrame
) -> DataFrame:
    """Mean metrics per retriever over all queries, also those without hits.

    ``rankings`` maps a name to any frame ``(qid, rank, doc_id, score)``. All
    retrievers are scored in one pass.
    """
    names = list(rankings)
    tagged = [
        df.select(F.lit(name).alias("retriever"), "qid", "rank", "doc_id")
        for name, df in rankings.items()
    ]
    scored = query_metrics(
        reduce(DataFrame.unionByName, tagged), qrels, ["retriever", "qid"]
    )
    asked = queries.select("qid").distinct().withColumn(
        "retriever", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    return (
        asked.join(scored, ["retriever", "qid"], "left")
        .groupBy("retriever")
        .agg(*[F.round(F.avg(F.coalesce(m, F.lit(0.0))), 4).alias(m) for m in METRICS])
    )


def compare(
    rankings: Mapping[str, DataFrame], qrels: DataFrame, queries: DataFrame
) -> DataFrame:
    """:func:`evaluate`, best NDCG@10 first."""
    return evaluate(rankings, qrels, queries).orderBy(F.col("ndcg_10").desc(), "retriever")


def melted(table: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A metric table in long form."""
    return table.unpivot(list(ids), list(values), "metric", "score")


# --- Predictions ----------------------------------------------------------------


def confusion(
    predictions: DataFrame, truth: str = "label", predicted: str = "prediction",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Counts per (true, predicted) pair and their share of the true class."""
    counts = predictions.groupBy(*keys, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    of_class = Window.partitionBy(*keys, truth)
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(of_class))


def class_report(
    cells: DataFrame, truth: str = "label", predicted: str = "prediction",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and support of every label seen as true or predicted.

    Works on confusion counts, so its input is small whatever the data size.
    """
    keys = list(keys)
    side = lambda column, name: cells.select(
        *keys,
        F.col(column).alias("class"),
        F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"),
        *[(F.col("n") if name == s else F.lit(0)).cast("bigint").alias(s) for s in ("support", "guessed")],
    )
    both = side(truth, "support").unionByName(side(predicted, "guessed"))
    sums = both.groupBy(*keys, "class").agg(
        (F.sum("hit") / 2).alias("hits"),  # a hit comes from both sides
        F.sum("support").alias("support"),
        F.sum("guessed").alias("guessed"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = sums.withColumn("precision", ratio(F.col("hits"), F.col("guessed"))).withColumn(
        "recall", ratio(F.col("hits"), F.col("support"))
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, p + r)).select(
        *keys, "class", "precision", "recall", "f1", "support", "hits"
    )


def summary(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro averages and support-weighted averages."""
    weighted = lambda m: F.sum(F.col(m) * F.col("support")) / F.sum("support")
    return report.groupBy(*keys).agg(
        F.round(F.sum("hits") / F.sum("support"), 4).alias("accuracy"),
        *[F.round(F.avg(m), 4).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.round(weighted(m), 4).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
    )
