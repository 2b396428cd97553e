"""Triage of narratives as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casegrain.functions import text
from casegrain.operators.retrieval import Bm25Index, bm25_search


def narrative_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files under ``path`` as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def rule_labelled(narratives: DataFrame, **rules) -> DataFrame:
    """Stateless part: ``(qid, text)`` cleaned and labelled by the keyword rules."""
    return narratives.select("qid", text.clean(F.col("text")).alias("cleaned_text")).withColumn(
        "category", text.taxonomy(F.col("cleaned_text"), **rules)
    )


def triaged(labelled: DataFrame, index: Bm25Index, k: int) -> DataFrame:
    """Similar cases of labelled narratives; one row stays when there is none."""
    asked = labelled.select("qid", F.col("cleaned_text").alias("text"))
    hits = bm25_search(asked, index, k)
    return labelled.select("qid", "category").join(hits, "qid", "left")


def triage_stream(
    narratives: DataFrame, index: Bm25Index, out: str, checkpoint: str, k: int = 3, **rules
) -> StreamingQuery:
    """Triage each micro-batch against a static index and write it to ``out``.

    A batch goes to a directory of its own, so a batch that is run again after
    a failure replaces its first attempt.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # cleaned and labelled once, read twice
        triaged(batch, index, k).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    return (
        rule_labelled(narratives, **rules)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
