"""A BM25 index that takes in arriving documents: immutable segments and a list of commits.

A segment is an index of some documents. What is added becomes a new one; of a document that
is already there the older version gets a tombstone. A commit names the segments and the
tombstones that count, and a reader pins one commit, so nothing it reads ever changes. Term
and length statistics are sums over segments, less those of documents with tombstones, so
scores are those of an index built at once. Compaction puts the living documents of all
segments into one.

Of two writers at once the second finds its commit's number taken (:mod:`casegrain.sources.commits`),
reads what the first has committed and tries again on top of it.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casegrain import fixed_values as fixed
from casegrain.operators.inverted import Part, planned
from casegrain.operators.retrieval import (
    Bm25Index,
    _ranked,
    document_terms,
    idf_of,
    index_of,
    query_terms,
    saturation,
)
from casegrain.operators.terms import exploded
from casegrain.sources.commits import CommitList
from casegrain.workspace import written

TRIES = 20


@dataclass
class Commit:
    """Segments in order of arrival, per segment the tombstone tables, per stream the last batch taken in."""

    segments: list[str] = field(default_factory=list)
    tombstones: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class SegmentedIndex:
    """The index under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = CommitList(spark, self.path)

    def pinned(self) -> tuple[int, Commit]:
        """The newest commit and its number; 0 and an empty one before the first."""
        number, content = self.commits.newest()
        return number, Commit(**content) if content else Commit()

    def _commit(self, number: int, commit: Commit) -> bool:
        return self.commits.create(number, asdict(commit))

    # --- Writing ---

    def _table(self, name: str, df: DataFrame) -> str:
        path = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/tables/{path}")
        return path

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tables/{name}")

    def _segment(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write rows of :func:`document_terms`, once, and index them beside; gives name and written rows."""
        name = f"segment-{uuid.uuid4().hex}"
        path = f"{self.path}/tables/{name}"
        rows.write.parquet(f"{path}/forward")
        forward = self.spark.read.schema(rows.schema).parquet(f"{path}/forward")
        index_of(forward, path=f"{path}/blocks").save(path, blocks=False)
        return name, forward

    def _dead(self, commit: Commit, segment: str) -> DataFrame | None:
        """``doc_id, len, terms`` of the documents of a segment that have a tombstone."""
        tables = [self._read(t) for t in commit.tombstones.get(segment, [])]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def add(self, docs: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Take in ``(doc_id, text)``, one row per id; older versions of these documents go.

        A batch of a stream is taken in once, however often it is run. Gives the commit's number.
        """
        name, forward = None, None
        for _ in range(TRIES):
            number, commit = self.pinned()
            if stream is not None and commit.batches.get(stream, -1) >= batch:
                return number
            if name is None:
                name, forward = self._segment(document_terms(docs))
            tombstones = {s: list(t) for s, t in commit.tombstones.items()}
            for segment in commit.segments:
                gone = self._read(f"{segment}/forward").join(forward.select("doc_id"), "doc_id", "left_semi")
                if (dead := self._dead(commit, segment)) is not None:
                    gone = gone.join(dead.select("doc_id"), "doc_id", "left_anti")
                gone = written(gone, "replaced")
                if not gone.isEmpty():
                    tombstones.setdefault(segment, []).append(self._table("tombstones", gone))
            batches = commit.batches | ({stream: batch} if stream is not None else {})
            if self._commit(number + 1, Commit([*commit.segments, name], tombstones, batches)):
                return number + 1
        raise RuntimeError(f"{self.path}: other writers came first {TRIES} times")

    def compact(self) -> int:
        """One segment of all living documents; readers of earlier commits keep what they read."""
        for _ in range(TRIES):
            number, commit = self.pinned()
            if not commit.segments:
                return number
            living = []
            for segment in commit.segments:
                rows = self._read(f"{segment}/forward")
                if (dead := self._dead(commit, segment)) is not None:
                    rows = rows.join(dead.select("doc_id"), "doc_id", "left_anti")
                living.append(rows)
            name, _ = self._segment(reduce(DataFrame.unionByName, living))
            if self._commit(number + 1, Commit([name], {}, commit.batches)):
                return number + 1
        raise RuntimeError(f"{self.path}: other writers came first {TRIES} times")

    def take_stream(self, docs: DataFrame, checkpoint: str, name: str = "arrivals") -> StreamingQuery:
        """Each micro-batch of a stream of ``(doc_id, text)`` as a segment; of an id's texts in one batch the largest counts."""

        def take(batch: DataFrame, number: int) -> None:
            one = batch.groupBy("doc_id").agg(F.max("text").alias("text"))
            if not one.isEmpty():
                self.add(one, name, number)

        return (
            docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    # --- Reading ---

    def search(
        self, queries: DataFrame, k: int = 10, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, **limits,
    ) -> DataFrame:
        """Top ``k`` living documents per query ``(qid, text)``, as of the newest commit.

        Statistics are read from the segments' own; no search scans documents, but those with tombstones.
        """
        _, commit = self.pinned()
        if not commit.segments:
            raise ValueError(f"{self.path}: no documents yet")
        parts, counts, terms = [], [], []
        for segment in commit.segments:
            index = Bm25Index.load(self.spark, f"{self.path}/tables/{segment}")
            dead = self._dead(commit, segment)
            parts.append(Part(index.blocks, index.layout, None if dead is None else dead.select("doc_id")))
            known = index.known
            counts.append((known["n_docs"], (known["avg_len"] or 0.0) * known["n_docs"]))
            terms.append(index.terms.select("term", "df"))
            if dead is not None:
                row = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
                counts.append((-row["n"], -row["len"]))
                terms.append(exploded(dead, [], "terms.term", "term").groupBy("term").agg(
                    (-F.count(F.lit(1))).alias("df")))
        n_docs, total = sum(n for n, _ in counts), round(sum(x for _, x in counts))
        avg_len = total / n_docs if total else 1.0
        asked = written(query_terms(queries), "segment-queries")
        mine = asked.select("term").distinct()
        df = reduce(DataFrame.unionByName, terms).join(mine, "term", "left_semi").groupBy("term").agg(
            F.sum("df").alias("df")).where("df > 0")
        weight = F.col("qtf") * idf_of(n_docs, F.col("df"))
        # The segments were built with mean lengths of their own; no impact reaches k1 + 1 under any.
        weighed = written(
            asked.join(df, "term").select(
                "qid", "term", weight.alias("weight"), (weight * (k1 + 1.0)).alias("most"), "df"),
            "segment-asked")
        return _ranked(planned(weighed, parts, saturation(k1, b, avg_len), k, **limits).scores, k)
