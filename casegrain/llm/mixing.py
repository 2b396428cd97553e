"""Mixing sources to target weights.

Words are counted per source, each source gets a target share, and every document is
emitted floor(rate) times, plus once more with probability rate - floor(rate), drawn
from a hash of the seed and its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.llm.shared import WORD, column, whole_row
from casegrain.workspace import written

WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in order of their code points, null last, weigh ``weights`` in turn and divide
    ``share`` of all words by weight. A target ends at ``most`` times its source's size;
    what is over goes to the other sources by weight, until none is above. The table has
    one row per source name, so ranking them is a small job beside the documents.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))) + 1)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = written(by_source.withColumn("weight", weight), "sources")
    cap = F.col("source_size") * most
    words = total.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # A source is full when the level per weight reaches its cap; the rest share what is left.
        filled = F.col("weight") * level >= cap if full >= 0 else F.lit(False)
        at = total.agg(
            F.coalesce(F.sum(F.when(filled, cap)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(filled, 1)).alias("full"),
        ).first()
        if at["full"] == full or at["open"] == 0:
            break
        full = at["full"]
        level = max(level, (words * share - at["used"]) / at["open"])
    return total.select("source", "source_size", F.least(F.col("weight") * level, cap).alias("target"))


def copies(rate: Column, doc_id: Column, seed: int) -> Column:
    """floor(rate), plus one where the document's draw in [0, 1) falls below the fraction."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42,
) -> DataFrame:
    """All columns of ``docs`` as ``row``, with ``size, source_size, target, rate, copies``.

    A null text has size 0; a null source is a source of its own, the last. A source without
    words has target and rate 0. Rows that agree in their id share one draw; a null id draws
    as the empty text. An empty table gives no rows.
    """
    # The joins below may move rows, so only what the mix needs travels with the row.
    rows = docs.select(
        whole_row(docs).alias("row"), column(id_col).cast("long").alias("doc_id"),
        column(source_col).cast("string").alias("source"), word_count(column(text_col)).alias("size"),
    )
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    named = targets.select(
        F.col("source").alias("of"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    return (
        rows.join(named, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        .withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document of ``docs``, repeated as often as it is taken."""
    taken = mixture(docs, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
