"""Approximate nearest vectors: coarse cells, product codes of the residuals, exact re-ranking.

Centroids and code books are trained on a bounded sample, those with the lowest id hash;
every vector is indexed. A query looks into the cells whose centroids are nearest, ranks
what is there by the codes, which are small and looked up in tables, and scores the best of
them exactly. Cells are stored in folders of their own and cut into pieces of a bounded
number of rows, so a cell that holds a third of all vectors is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed
from casegrain.operators.ranking import hash_key, top_k
from casegrain.workspace import fresh_path, written

SCORE_DIGITS = 6
#: Rows to train on, cells at most, parts of a vector with a code each, values of a code.
SAMPLE, MOST_CELLS, PARTS, CODES = 20_000, 1024, 16, 64
#: Share of the cells a query looks into; candidates scored exactly per result wanted, in each piece
#: of a cell. Vectors with hardly any structure need that many cells for a recall of 0.9; where they
#: do lie in clusters far fewer do, and ``probes`` says how many.
PROBED, RERANKED = 0.75, 4
PIECE_ROWS, STEPS = 20_000, 15


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each row."""
    return (np.einsum("ij,ij->i", centres, centres) - 2 * rows @ centres.T).argmin(axis=1)


def clustered(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's steps from distinct rows; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:n]].copy()
    for _ in range(STEPS):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass(frozen=True)
class Codebook:
    """Cell centres, and per part of a residual its code's values; vectors are filled up to whole parts."""

    centres: np.ndarray
    books: list[np.ndarray]
    width: int

    @classmethod
    def fit(cls, rows: np.ndarray, cells: int, parts: int, codes: int, seed: int) -> Codebook:
        width = rows.shape[1]
        rows = filled(rows, parts)
        centres = clustered(rows, cells, seed)
        residual = rows - centres[nearest(rows, centres)]
        books = [clustered(x, codes, seed + 1 + i) for i, x in enumerate(np.split(residual, parts, axis=1))]
        return cls(centres, books, width)

    def encoded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = filled(rows, len(self.books))
        cell = nearest(rows, self.centres)
        parts = np.split(rows - self.centres[cell], len(self.books), axis=1)
        return cell, np.stack([nearest(x, b) for x, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def estimated(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products by the codes: the centre's, and one table entry per part."""
        query = filled(query[None, :], len(self.books))[0]
        tables = [b @ q for b, q in zip(self.books, np.split(query, len(self.books)))]
        return query @ self.centres[cell] + sum(t[codes[:, i]] for i, t in enumerate(tables))


def filled(rows: np.ndarray, parts: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % parts)))


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


@dataclass(frozen=True)
class VectorIndex:
    """``rows(doc_id, vector, code, piece, cell)``, in a folder per cell, and the code book."""

    rows: DataFrame
    book: Codebook

    @classmethod
    def build(
        cls, docs: DataFrame, sample: int = SAMPLE, cells: int | None = None, parts: int = PARTS, codes: int = CODES,
        piece_rows: int = PIECE_ROWS, seed: int = fixed.SEED,
    ) -> VectorIndex:
        """Index all of ``docs(doc_id, vector)``, vectors of one length; at most ``sample`` of them are trained on.

        Half as many cells as the root of the number of vectors, unless told otherwise.
        """
        spark = docs.sparkSession
        held = docs.where(F.col("vector").isNotNull()).select(
            "doc_id", F.col("vector").cast("array<double>").alias("vector"))
        table = held.orderBy(hash_key("doc_id", seed), "doc_id").limit(sample).select("vector").toArrow()
        if not table.num_rows:
            raise ValueError("no vectors to index")
        if not 0 < codes <= 256:
            raise ValueError("a code is one byte")
        cells = cells or min(max(int(held.count() ** 0.5 / 2), 1), MOST_CELLS)
        book = Codebook.fit(_matrix(table["vector"]), cells, parts, codes, seed)
        shared = spark.sparkContext.broadcast(book)

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, code = shared.value.encoded(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()),
                     pa.array(cell.astype(np.int32))], names=["doc_id", "vector", "code", "cell"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        coded = written(
            held.mapInArrow(encoded, f"doc_id {kind}, vector array<double>, code binary, cell int"), "vector-codes")
        sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / piece_rows).alias("pieces"))
        # One row per cell, so far below any limit.
        placed = coded.join(F.broadcast(sizes), "cell").select(
            "doc_id", "vector", "code", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int").alias("piece"), "cell")
        path = fresh_path(spark, "vector-cells")
        placed.repartition("cell", "piece").write.partitionBy("cell").parquet(path)
        return cls(spark.read.schema(placed.schema).parquet(path), book)

    def search(
        self, queries: DataFrame, k: int = 10, probes: int | None = None, reranked: int = RERANKED,
    ) -> DataFrame:
        """Approximately the top ``k`` per query ``(qid, vector)`` by inner product, with exact scores.

        Queries are sent to the cells they look into; a piece of a cell gives ``k`` rows per query.
        """
        spark = queries.sparkSession
        probes = probes or ceil(PROBED * len(self.book.centres))
        shared = spark.sparkContext.broadcast(self.book)
        qid, doc = (t.schema[c].dataType.simpleString() for t, c in ((queries, "qid"), (self.rows, "doc_id")))

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = shared.value
            for batch in batches:
                rows = filled(_matrix(batch.column(1)), len(book.books))
                order = np.argsort(-(rows @ book.centres.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    names=["qid", "vector", "cells"])

        asked = written(
            queries.where(F.col("vector").isNotNull())
            .select("qid", F.col("vector").cast("array<double>").alias("vector"))
            .mapInArrow(probed, f"qid {qid}, vector array<double>, cells array<int>")
            .select("qid", "vector", F.explode("cells").alias("cell")),
            "probes")
        pieces = written(self.rows.select("cell", "piece").distinct(), "vector-pieces")
        fields = f"qid {qid}, doc_id {doc}, score double"
        schema = spark.createDataFrame([], fields).toArrow().schema
        found = self.rows.groupBy("cell", "piece").cogroup(
            asked.join(pieces, "cell").groupBy("cell", "piece")
        ).applyInArrow(_ranked_in_piece(shared, k, reranked, schema), fields)
        return top_k(found, k)


def _ranked_in_piece(shared, k: int, reranked: int, schema: pa.Schema):
    def ranked(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        book, cell = shared.value, key[0].as_py()
        vectors, queries = _matrix(rows["vector"]), _matrix(asked["vector"])
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        query_of, row_of, scores = [], [], []
        for i, query in enumerate(queries):
            guess = book.estimated(query, cell, codes)
            most = min(k * reranked, len(guess))
            best = np.argpartition(-guess, most - 1)[:most]
            exact = np.round(vectors[best] @ query, SCORE_DIGITS)
            # Scores equal to the k-th all stay in; ties are settled over all pieces.
            kept = exact >= (np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) > k else -np.inf)
            query_of.append(np.full(kept.sum(), i))
            row_of.append(best[kept])
            scores.append(exact[kept])
        columns = (asked["qid"].take(pa.array(np.concatenate(query_of))),
                   rows["doc_id"].take(pa.array(np.concatenate(row_of))), pa.array(np.concatenate(scores)))
        return pa.table(columns, schema.names).cast(schema)

    return ranked
