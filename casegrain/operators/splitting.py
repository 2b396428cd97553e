"""Stratified train / validation / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.operators.ranking import hash_key, ranked_in_group
from casegrain.workspace import written

SPLITS = ["train", "val", "test"]


def split_edges(
    df: DataFrame, label: str, id_column: str, train_percent: int, seed: int
) -> DataFrame:
    """One row per class: the last training and the last validation row in hash order.

    A class of ``n`` rows gives ``n * percent div 100`` to training, half of
    the rest (rounded down) to validation and what remains to the test.
    """
    ranked = ranked_in_group(
        df.select(label, id_column), label, id_column, seed, rank="_rank", size="_size"
    )
    train = F.expr(f"_size * {train_percent} div 100")
    val = F.expr(f"(_size - _size * {train_percent} div 100) div 2")
    position = F.struct(hash_key(id_column, seed).alias("hash"), F.col(id_column).alias("id"))
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, position))
    return ranked.groupBy(label).agg(
        at(train).alias("_train_end"), at(train + val).alias("_val_end")
    )


def stratified_split(
    df: DataFrame, label: str = "primary_category", id_column: str = "complaint_id",
    train_percent: int = fixed.TRAIN_PERCENT, seed: int = fixed.SEED, keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: exact shares per class, disjoint and covering.

    Rows without a class are a class of their own and are split alike.
    Only ids and labels are ranked. The rows themselves stay where they are and
    are compared with the edges of their class, a written table of one row per
    class that Spark broadcasts by its known size. ``keys`` are the same rows' ids and labels
    without the plan of costly columns, which would run for the ranks too.
    """
    ranked = df if keys is None else keys
    edges = written(split_edges(ranked, label, id_column, train_percent, seed), "split-edges")
    position = F.struct(hash_key(id_column, seed).alias("hash"), F.col(id_column).alias("id"))
    split = (
        F.when(position <= F.col("_train_end"), "train")
        .when(position <= F.col("_val_end"), "val")
        .otherwise("test")
    )
    by_label = edges.withColumnRenamed(label, "_label")
    return (
        df.join(by_label, F.col(label).eqNullSafe(F.col("_label")))
        .withColumn("split", split)
        .drop("_label", "_train_end", "_val_end")
    )


def split_parity(split: DataFrame, label: str = "primary_category") -> DataFrame:
    """Percent of each class in the training and the test split, side by side."""
    wanted = ["train", "test"]
    counts = written(
        split.groupBy(label).agg(*[F.count_if(F.col("split") == s).alias(s) for s in wanted]),
        "split-counts",
    )
    percent = lambda s: F.round(
        F.lit(100.0) * F.col(s) / F.nullif(counts.agg(F.sum(s)).scalar(), F.lit(0)), 2
    )
    return counts.select(label, *[percent(s).alias(f"{s}_percent") for s in wanted])
