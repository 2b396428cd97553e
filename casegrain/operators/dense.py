"""Dense vectors: unit length, nearest documents by inner product."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.operators.ranking import top_k

SCORE_DIGITS = 6
# Vector elements (8 bytes each) of the queries and of the documents that meet in a task.
QUERY_CELLS, DOC_CELLS = 4_000_000, 8_000_000


def with_unit_vectors(df: DataFrame, vector: str, out: str = "vector") -> DataFrame:
    """Add ``out``, the vector divided by its length, in double.

    A zero vector stays zero. The length is a projection of its own, since
    inside the lambda it would be summed again for every element.
    """
    return (
        df.withColumn("_doubles", F.col(vector).cast("array<double>"))
        .withColumn(
            "_length",
            F.sqrt(F.aggregate("_doubles", F.lit(0.0), lambda acc, x: acc + x * x)),
        )
        .withColumn(
            out,
            F.transform(
                "_doubles",
                lambda x: F.when(F.col("_length") > 0, x / F.col("_length")).otherwise(x),
            ),
        )
        .drop("_doubles", "_length")
    )


def inner_product(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


class _Best:
    """The best ``k`` documents of each query seen so far."""

    def __init__(self, qids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool):
        self.qids, self.vectors, self.k, self.exclude_self = qids, vectors, k, exclude_self
        self.frames: list[pd.DataFrame] = []
        self.rows = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        # Query rows in slices, so that the score block stays small.
        step = max(1, 4_000_000 // max(1, len(ids)))
        for start in range(0, len(self.qids), step):
            qids = self.qids[start:start + step]
            scores = np.round(self.vectors[start:start + step] @ vectors.T, SCORE_DIGITS)
            if self.exclude_self:
                scores[qids[:, None].astype(str) == ids[None, :].astype(str)] = -np.inf
            if len(ids) > self.k:
                # All scores equal to the k-th stay in, ties are settled below.
                cut = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                q, d = np.nonzero(scores >= cut[:, None])
            else:
                q, d = np.indices(scores.shape).reshape(2, -1)
            found = pd.DataFrame({"qid": qids[q], "doc_id": ids[d], "score": scores[q, d]})
            self.frames.append(found[np.isfinite(found["score"])])
            self.rows += len(found)
        if self.rows > 4 * self.k * len(self.qids):
            self.frames = [self.best()]
            self.rows = len(self.frames[0])

    def best(self) -> pd.DataFrame:
        if not self.frames:
            return pd.DataFrame({"qid": self.qids[:0], "doc_id": self.qids[:0], "score": []})
        ordered = pd.concat(self.frames).sort_values(
            ["qid", "score", "doc_id"], ascending=[True, False, True], kind="stable"
        )
        return ordered.groupby("qid", sort=False).head(self.k)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)


def dense_scores(
    queries: DataFrame, docs: DataFrame, k: int, exclude_self: bool = False,
    query_cells: int = QUERY_CELLS, doc_cells: int = DOC_CELLS,
) -> DataFrame:
    """Candidates ``(qid, doc_id, score)``, at most ``k`` per query and task.

    Every query is scored against every document by block-wise matrix products.
    Both sides are cut into blocks of a bounded number of elements by hash, and
    each block of queries meets each block of documents in a task of its own:
    queries are sent once per block of documents and the other way round, no
    vector passes the driver, and a task gives ``k`` documents per query.
    """
    schema = _score_schema(queries, docs)
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    held = docs.select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    n_queries, width = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if n_queries == 0:
        return queries.sparkSession.createDataFrame([], schema)
    n_docs = held.agg(F.count(F.lit(1))).first()[0]
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = -(-n_queries * width // query_cells)
    parts = max(-(-n_docs * width // doc_cells), min(cores, n_docs), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_hash = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = held.withColumn("_part", of_hash("doc_id", parts)).withColumn("_block", every(blocks))
    right = asked.withColumn("_block", of_hash("qid", blocks)).withColumn("_part", every(parts))
    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(
        _scorer(k, exclude_self, queries.sparkSession.createDataFrame([], schema).toArrow().schema), schema)


def _scorer(k: int, exclude_self: bool, schema: pa.Schema):
    """Scores a block of documents against a block of queries."""

    def scored(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return schema.empty_table()
        best = _Best(asked["qid"].to_numpy(), _matrix(asked["vector"]), k, exclude_self)
        best.add(docs["doc_id"].to_numpy(), _matrix(docs["vector"]))
        return pa.Table.from_pandas(best.best(), schema, preserve_index=False)

    return scored


def _score_schema(queries: DataFrame, docs: DataFrame) -> str:
    qid = queries.schema["qid"].dataType.simpleString()
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return f"qid {qid}, doc_id {doc_id}, score double"


def dense_search(
    queries: DataFrame, docs: DataFrame, k: int = 10, exclude_self: bool = False, **blocks
) -> DataFrame:
    """Top ``k`` of ``docs(doc_id, vector)`` per query ``(qid, vector)``.

    Unit vectors are expected; there is no lower bound on the score.
    """
    return top_k(dense_scores(queries, docs, k, exclude_self, **blocks), k)
