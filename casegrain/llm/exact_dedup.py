"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every partition of the documents sorts its distinct 64-bit fingerprints and sends
   each owner (a range of fingerprints) one block of them, Golomb-Rice coded.
2. Owners decode their blocks and answer each with a bitmap: which of its
   fingerprints came from another partition too.
3. A document whose bit is set, or that has an equal fingerprint beside it, is a
   suspect. Only suspects' texts are shuffled; grouping by the text itself compares
   every byte. All other documents never leave their partition.

A partition reads its blocks and bitmaps from the shared folder, by its number. If
the documents are not dealt out as they were in step 1, a fingerprint is missing there
and the job stops: a table that was shuffled at random has to be written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm.shared import column, mounted_folder, partitions, whole_row
from casegrain.workspace import written

BLOCK = ("chunk long, owner int, n int, width int, first long, quotients binary, rests binary, "
         "repeated binary")


def golomb_encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Sorted distinct uint64 values: width, first value, unary quotients, fixed-width rests."""
    gaps = np.diff(values)
    mean = (int(values[-1]) - int(values[0])) // max(1, len(gaps))
    width = max(0, mean.bit_length() - 1)
    ends = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    places = np.arange(width, dtype=np.uint64)
    rests = (gaps[:, None] >> places & np.uint64(1)).astype(np.uint8)
    return (width, int(values[0].astype(np.int64)), np.packbits(unary).tobytes(),
            np.packbits(rests.ravel()).tobytes())


def golomb_decode(n: int, width: int, first: int, quotients: bytes, rests: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[: n - 1]
    whole = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(width)
    bits = np.unpackbits(np.frombuffer(rests, np.uint8))[: (n - 1) * width].reshape(n - 1, width)
    places = np.arange(width, dtype=np.uint64)
    gaps = whole + (bits.astype(np.uint64) << places).sum(axis=1, dtype=np.uint64)
    start = np.array([first], np.int64).view(np.uint64)
    return np.concatenate([start, start + np.cumsum(gaps, dtype=np.uint64)])


def _send(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column(0)).view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        owner = ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        blocks = np.split(values, cuts)
        coded = [golomb_encode(block) for block in blocks]
        repeated = [np.packbits(bits).tobytes() for bits in np.split(counts > 1, cuts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int64()),
             pa.array(owner[np.concatenate([[0], cuts]).astype(int)], pa.int32()),
             pa.array([len(block) for block in blocks], pa.int32()),
             *(pa.array(part, kind) for part, kind in zip(
                 zip(*coded), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))),
             pa.array(repeated, pa.binary())],
            names=["chunk", "owner", "n", "width", "first", "quotients", "rests", "repeated"])

    return send


def _decoded(table: pa.Table) -> list[np.ndarray]:
    return [golomb_decode(r["n"], r["width"], r["first"], r["quotients"], r["rests"])
            for r in table.select(["n", "width", "first", "quotients", "rests"]).to_pylist()]


def _answer(table: pa.Table) -> pa.Table:
    """One owner's blocks: for each the bitmap of fingerprints that other blocks hold too."""
    blocks = _decoded(table)
    _, place, count = np.unique(np.concatenate(blocks), return_inverse=True, return_counts=True)
    shared = (count > 1)[place]
    cuts = np.cumsum([len(b) for b in blocks])[:-1]
    bitmaps = [np.packbits(bits).tobytes() for bits in np.split(shared, cuts)]
    return pa.table({"chunk": table["chunk"], "owner": table["owner"],
                     "bitmap": pa.array(bitmaps, pa.binary())})


def _read(path: str) -> pa.Table | None:
    try:
        return pq.ParquetDataset(path, partitioning=None).read()
    except FileNotFoundError:
        return None


def _bits(bitmaps: pa.ChunkedArray, sizes: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([
        np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
        for bitmap, n in zip(bitmaps.to_pylist(), sizes.to_pylist())
    ])


def _suspect(blocks_path: str, answers_path: str):
    @F.arrow_udf("boolean")
    def suspect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunk = TaskContext.get().partitionId()
        sent = _read(f"{blocks_path}/chunk={chunk}")
        known, flagged = np.zeros(0, np.uint64), np.zeros(0, bool)
        if sent is not None:
            sent = sent.sort_by("owner")
            answers = _read(f"{answers_path}/chunk={chunk}").sort_by("owner")
            known = np.concatenate(_decoded(sent))
            flagged = _bits(answers["bitmap"], sent["n"]) | _bits(sent["repeated"], sent["n"])
        for batch in batches:
            values = np.asarray(batch).view(np.uint64)
            if not len(values):
                yield pa.array([], pa.bool_())
                continue
            at = np.searchsorted(known, values)
            if not len(known) or (known[np.minimum(at, len(known) - 1)] != values).any():
                raise RuntimeError("the documents are dealt out differently than before; write them first")
            yield pa.array(flagged[at])

    return suspect


def _with_suspects(docs: DataFrame, text_col: str) -> DataFrame:
    """``row`` (all columns), ``text``, and ``suspect``: whether an equal fingerprint was seen."""
    spark = docs.sparkSession
    owners = partitions(spark)
    rows = docs.select(
        whole_row(docs).alias("row"), F.coalesce(column(text_col), F.lit("")).alias("text")
    ).withColumn("fingerprint", F.xxhash64("text"))
    blocks_uri, blocks_path = mounted_folder(spark, "dedup-blocks")
    answers_uri, answers_path = mounted_folder(spark, "dedup-answers")
    sent = rows.select("fingerprint").mapInArrow(_send(owners), BLOCK)
    sent.write.mode("overwrite").partitionBy("chunk").parquet(blocks_uri)
    blocks = spark.read.schema(BLOCK).parquet(blocks_uri)
    answers = blocks.groupBy("owner").applyInArrow(_answer, "chunk long, owner int, bitmap binary")
    answers.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(answers_uri)
    return rows.withColumn("suspect", _suspect(blocks_path, answers_path)("fingerprint"))


def _verified(suspects: DataFrame) -> DataFrame:
    """Suspects' groups by whole text: ``text_sha256``, ``best`` (largest id, then number), ``group_size``.

    Partitions combine their own copies first, so a group of any size sends one row each.
    """
    return suspects.groupBy("text_sha256", "text").agg(
        F.max(F.struct("doc_id", "number")).alias("best"), F.count("*").alias("group_size")
    ).drop("text")


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when all their bytes are; null is the empty text. Of equal texts the
    row with the largest id stays; null ids come before all others, and of rows that agree
    in id and text one stays. An empty table gives no rows.
    """
    rows = _with_suspects(docs, text_col).select(
        F.col("row")[id_col].cast("long").alias("doc_id"), "text", "suspect",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
    suspects = written(
        rows.where("suspect").drop("suspect").withColumn("number", F.monotonically_increasing_id()),
        "dedup-suspects",
    )
    groups = written(_verified(suspects), "dedup-groups")
    alone = rows.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    copies = suspects.drop("text").join(groups, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("number") == F.col("best.number")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(copies)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; see :func:`equal_texts`.

    Null is the empty text; of rows equal in id and text one stays; an empty table stays empty.
    """
    rows = _with_suspects(docs, text_col)
    suspects = written(
        rows.where("suspect").select(
            "row", "text", F.col("row")[id_col].cast("long").alias("doc_id"),
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "dedup-suspects",
    )
    best = _verified(suspects).select(F.col("best.number").alias("number"))
    kept = suspects.join(best, "number", "left_semi").select("row.*")
    return rows.where(~F.col("suspect")).select("row.*").unionByName(kept)
