"""From ``documents`` to packed training sequences: five stages, each written and read again.

1. toxicity: documents that the classifier rejects go.
2. exact dedup: of equal texts the one with the largest id stays.
3. near dedup: of texts whose SimHash fingerprints link at 3 or fewer bits the one with the smallest id stays.
4. mixing: documents are repeated or left out until sources meet their target weights.
5. packing: pieces of documents, laid out in sequences.

A stage takes and returns the columns of ``documents``, the last one returns pieces.
Null texts count as empty, repeated rows as rows of their own, further columns ride along whatever
their names; an empty table gives an empty result in each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casegrain.llm import exact_dedup, mixing, packing, simhash, toxicity
from casegrain.workspace import read_table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; an empty text scores like one without features, so it stays."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the largest id; null and empty texts are one group."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the smallest id; of rows that share an id the first."""
    return simhash.without_near_copies(docs, shingle=3, radius=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row none to several times; rows without words come at their source's rate too."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row, an empty text's end token included."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashes and packing are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
