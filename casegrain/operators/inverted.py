"""Inverted files in blocks, and an exact top-k search that opens only blocks that can matter.

A block holds the postings of one term in one slice of the documents (a hash of the document
id), so a frequent term has as many blocks as there are slices and no task or row holds all
of its postings. Blocks lie in folders, as many as the postings need, and those of a frequent
term spread over several.

A search sums non-negative contributions, weight * impact, over a query's terms:

1. Threshold: the terms that can contribute most, up to a number of postings, are scored. The
   k-th best of these partial sums is a bound that the k-th best document reaches.
2. Terms that cannot reach the bound together, those that contribute least, are left out: a
   document with no other term is out. All others are scored, and a document whose sum and
   all that the left-out terms could add stay below the bound is out too.
3. Only in slices that still have documents, blocks of the left-out terms are opened, and what
   they add to those documents is summed.

Where all blocks of the terms asked for are few they are opened at once, without a threshold.

The result is exact in either case. What moves is blocks of the terms asked for, to the task of
their slice, and there numpy adds them up; no row per (query, document) is made before the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.operators.ranking import first_per_group
from casegrain.workspace import written

#: Documents of a slice, postings of a folder, slices of a term that share a folder.
SLICE_DOCS, FOLDER_POSTINGS, SLICES_TOGETHER = 1 << 14, 1 << 22, 64
LEAST_SLICE_DOCS, LEAST_FOLDER_POSTINGS = 512, 1 << 16
#: Postings scored for a query's threshold, rows (query, term) that a task scores at once, and
#: the number of postings up to which all blocks of the terms asked for are opened.
LEAD_POSTINGS, ASKED_AT_ONCE, OPEN_AT_ONCE = 20_000, 200_000, 20_000_000
#: Terms are left out that together add at most this share of the threshold; more of them would
#: leave more documents in question than the postings they spare.
LEFT_OUT = 0.5
#: Scores are rounded to six places afterwards; what may round to the bound stays in.
MARGIN = 1e-5

#: Impacts of postings from their values and document lengths.
Impact = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Layout:
    """Into how many slices and folders an index is cut."""

    slices: int
    folders: int

    @classmethod
    def of(cls, n_docs: int, n_postings: int, cores: int) -> Layout:
        """By the size of the corpus; a small one has slices for all cores."""
        slices = max(-(-n_docs // SLICE_DOCS), min(2 * cores, n_docs // LEAST_SLICE_DOCS), 1)
        folders = max(-(-n_postings // FOLDER_POSTINGS), min(cores, n_postings // LEAST_FOLDER_POSTINGS), 1)
        return cls(slices, folders)

    def slice_of(self, doc_id: Column | str) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.slices)).cast("int")

    def folder_of(self, term: Column | str, run: Column) -> Column:
        """The folder of a term's blocks in a run of ``SLICES_TOGETHER`` slices."""
        return F.pmod(F.xxhash64(term) + run, F.lit(self.folders)).cast("int")

    def runs(self) -> Column:
        return F.sequence(F.lit(0), F.lit((self.slices - 1) // SLICES_TOGETHER))


def write_blocks(postings: DataFrame, layout: Layout, path: str) -> DataFrame:
    """``postings(term, doc_id, value, len, impact)`` as blocks, with one shuffle.

    ``bucket`` is the folder, ``top`` the largest impact of the block.
    """
    spark = postings.sparkSession
    run = F.floor(F.col("slice") / SLICES_TOGETHER).cast("int")
    dealt = postings.withColumn("slice", layout.slice_of("doc_id")).withColumn("bucket", layout.folder_of("term", run))
    posting = F.struct("doc_id", "value", "len")
    blocks = (
        dealt.repartition(max(layout.folders, spark.sparkContext.defaultParallelism), "bucket")
        .groupBy("bucket", "term", "slice")
        .agg(F.collect_list(posting).alias("p"), F.max("impact").alias("top"))
        .select("term", "slice", F.col("p.doc_id").alias("docs"), F.col("p.value").alias("values"),
                F.col("p.len").alias("lens"), "top", "bucket")
    )
    save_blocks(blocks, path)
    return spark.read.schema(blocks.schema).parquet(path)


def write_document_blocks(
    rows: DataFrame, value: str, impact: Impact, layout: Layout, path: str,
) -> DataFrame:
    """``rows(doc_id, len, terms)`` as the same blocks; ``value`` is the field of a term that a posting keeps.

    Documents move whole to the task of their slice, which cuts them into blocks; no row per
    posting is made. The blocks then move once, to their folders.
    """
    spark = rows.sparkSession
    doc = rows.schema["doc_id"].dataType.simpleString()
    entry = lambda x: F.struct(x["term"].alias("term"), x[value].alias("value"))
    plain = len(rows.schema["terms"].dataType.elementType.fields) == 2
    terms = F.col("terms") if plain else F.transform("terms", entry).alias("terms")
    schema = f"term string, slice int, docs array<{doc}>, values array<double>, lens array<bigint>, top double"
    run = F.floor(F.col("slice") / SLICES_TOGETHER).cast("int")
    blocks = (
        rows.where(F.size("terms") > 0).select("doc_id", F.col("len").cast("bigint").alias("len"), terms)
        .groupBy(layout.slice_of("doc_id").alias("slice")).applyInArrow(_sliced(impact), schema)
        .withColumn("bucket", layout.folder_of("term", run))
    )
    save_blocks(blocks, path)
    return spark.read.schema(blocks.schema).parquet(path)


def _sliced(impact: Impact):
    """The blocks of one slice's documents."""

    def sliced(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lists = rows["terms"].combine_chunks()
        row = pc.list_parent_indices(lists).to_numpy()
        term, value = lists.flatten().flatten()
        coded = term.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(codes * rows.num_rows + row)
        codes, row = codes[order], row[order]
        values, lens = value.to_numpy()[order].astype(np.float64), rows["len"].to_numpy()[row]
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        offsets = pa.array(np.append(starts, len(codes)).astype(np.int32))
        docs = rows["doc_id"].combine_chunks().take(pa.array(row))
        of_term = lambda flat: pa.ListArray.from_arrays(offsets, flat)
        return pa.table({
            "term": coded.dictionary.take(pa.array(codes[starts])),
            "slice": pa.array(np.full(len(starts), key[0].as_py(), np.int32)),
            "docs": of_term(docs), "values": of_term(pa.array(values)), "lens": of_term(pa.array(lens)),
            "top": pa.array(np.maximum.reduceat(impact(values, lens), starts)),
        })

    return sliced


def term_sizes(blocks: DataFrame) -> DataFrame:
    """``term, df, top`` of written blocks: postings and largest impact of each term."""
    return blocks.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max("top").alias("top"))


def save_blocks(blocks: DataFrame, path: str) -> None:
    """One file per folder, sorted by term."""
    blocks.repartition("bucket").sortWithinPartitions("bucket", "term", "slice").write.mode(
        "overwrite").partitionBy("bucket").parquet(path)


def opened(blocks: DataFrame, layout: Layout, terms: DataFrame) -> DataFrame:
    """The blocks in the folders of some terms; at most one number per folder on the driver."""
    if layout.folders == 1:
        return blocks
    folder = layout.folder_of("term", F.col("run"))
    found = terms.select("term").distinct().select("term", F.explode(layout.runs()).alias("run"))
    numbers = [r["folder"] for r in found.select(folder.alias("folder")).distinct().collect()]
    return blocks.where(F.col("bucket").isin(numbers))


# --- Inside a slice -----------------------------------------------------------------


class _Slice:
    """Blocks of one slice: documents by number, in order of their ids, and impacts by term."""

    def __init__(self, blocks: pa.Table, impact: Impact, barred: list[dict] = ()):
        docs = blocks["docs"].combine_chunks()
        flat = docs.flatten()
        coded = flat.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.ids = coded.dictionary.take(order)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        self.number = place[coded.indices.to_numpy()]
        values, lens = (blocks[c].combine_chunks().flatten().to_numpy() for c in ("values", "lens"))
        self.impact = impact(values, lens)
        ends = np.cumsum(pc.list_value_length(docs).to_numpy())
        self.of_term = dict(zip(blocks["term"].to_pylist(), zip(np.append(0, ends)[:-1].tolist(), ends.tolist())))
        self._names = None
        self.barred = np.zeros(0, np.int64)
        if barred:
            gone = pc.index_in(pa.array([r["doc_id"] for r in barred], self.ids.type), value_set=self.ids)
            self.barred = gone.drop_null().to_numpy()

    def sums(self, asked: list[tuple[str, float]]) -> np.ndarray:
        total = np.zeros(len(self.ids))
        for term, weight in asked:
            if term in self.of_term:
                start, end = self.of_term[term]
                total[self.number[start:end]] += weight * self.impact[start:end]
        total[self.barred] = 0.0
        return total

    def without(self, total: np.ndarray, qid) -> np.ndarray:
        """A query does not find the document that has its id."""
        if self._names is None:
            self._names = {str(x): i for i, x in enumerate(self.ids.to_pylist())}
        if (own := self._names.get(str(qid))) is not None:
            total[own] = 0.0
        return total


def _by_query(work: pa.Table) -> dict[object, list[dict]]:
    """The work's rows by query; those without one name documents that nothing finds."""
    rows: dict[object, list[dict]] = {}
    for row in work.to_pylist():
        rows.setdefault(row["qid"], []).append(row)
    return rows


def _kth(total: np.ndarray, k: int) -> float:
    """The k-th largest sum, 0 if fewer documents have one."""
    return float(np.partition(total, len(total) - k)[len(total) - k]) if 0 < k <= len(total) else 0.0


def _thresholds(impact: Impact, k: int, exclude_self: bool, schema: pa.Schema):
    """Per query the best ``k`` partial sums of a slice."""

    def thresholds(key, blocks: pa.Table, work: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if blocks.num_rows:
            asked = _by_query(work)
            slice_ = _Slice(blocks, impact, asked.pop(None, ()))
            for qid, rows in asked.items():
                total = slice_.sums([(r["term"], r["weight"]) for r in rows])
                if exclude_self:
                    total = slice_.without(total, qid)
                best = total[(total > 0) & (total >= _kth(total, k))]
                found += [(qid, x) for x in np.sort(best)[::-1][:k].tolist()]
        return pa.table([pa.array([r[i] for r in found], t) for i, t in enumerate(schema.types)], schema.names)

    return thresholds


def _survivors(impact: Impact, k: int, exclude_self: bool, schema: pa.Schema):
    """Documents of a slice that the left-out terms could still lift to the bound."""

    def survivors(key, blocks: pa.Table, work: pa.Table) -> pa.Table:
        tables = []
        if blocks.num_rows:
            asked = _by_query(work)
            slice_ = _Slice(blocks, impact, asked.pop(None, ()))
            for qid, rows in asked.items():
                total = slice_.sums([(r["term"], r["weight"]) for r in rows])
                if exclude_self:
                    total = slice_.without(total, qid)
                rest, bound = rows[0]["rest"], max(rows[0]["bound"], _kth(total, k))
                kept = np.flatnonzero((total > 0) & (total + rest >= bound - MARGIN))
                columns = (pa.array([qid] * len(kept), schema.types[0]),
                           pa.array(np.full(len(kept), key[0].as_py(), np.int32)),
                           slice_.ids.take(pa.array(kept)).cast(schema.types[2]), pa.array(total[kept]))
                tables.append(pa.table(columns, schema.names))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return survivors


def _completed(impact: Impact, schema: pa.Schema):
    """What the left-out terms add to the documents that are still in."""

    def completed(key, blocks: pa.Table, work: pa.Table) -> pa.Table:
        slice_ = _Slice(blocks, impact) if blocks.num_rows else None
        tables = []
        asked = _by_query(work)
        asked.pop(None, None)
        for qid, rows in asked.items():
            docs = [r for r in rows if r["term"] is None]
            ids = pa.array([r["doc_id"] for r in docs], schema.types[1])
            score = np.array([r["weight"] for r in docs], np.float64)
            if slice_ is not None and docs:
                total = slice_.sums([(r["term"], r["weight"]) for r in rows if r["term"] is not None])
                place = pc.index_in(ids, value_set=slice_.ids.cast(schema.types[1]))
                known = place.is_valid().to_numpy(zero_copy_only=False)
                score[known] += total[place.drop_null().to_numpy()]
            tables.append(pa.table((pa.array([qid] * len(docs), schema.types[0]), ids, pa.array(score)), schema.names))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return completed


# --- Search -------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """Blocks in their layout, and documents ``(doc_id)`` of them that a search has to pass over."""

    blocks: DataFrame
    layout: Layout
    barred: DataFrame | None = None


@dataclass(frozen=True)
class Search:
    """A planned search: ``scores(qid, doc_id, score)`` and the tables that say what it opens, if it is bounded."""

    scores: DataFrame
    essential: DataFrame
    left_out: DataFrame | None = None
    survivors: DataFrame | None = None
    completing: DataFrame | None = None


class _Opened:
    """Blocks of the terms asked for, brought together with the work on their slice."""

    def __init__(self, asked: DataFrame, parts: Sequence[Part], impact: Impact, groups: int):
        self.impact, self.groups = impact, groups
        self.qid = asked.schema["qid"].dataType.simpleString()
        self.doc = parts[0].blocks.schema["docs"].dataType.elementType.simpleString()
        self.spark = asked.sparkSession
        blocks, barred, self.slices = [], [], 0
        for part in parts:
            # The slices of all parts are numbered through.
            shifted = (F.col("slice") + self.slices).alias("slice")
            found = opened(part.blocks, part.layout, asked)
            blocks.append(found.select("term", shifted, "docs", "values", "lens"))
            if part.barred is not None:
                barred.append(part.barred.select(
                    (part.layout.slice_of("doc_id") + self.slices).alias("slice"), "doc_id"))
            self.slices += part.layout.slices
        self.blocks = reduce(DataFrame.unionByName, blocks)
        self.barred = reduce(DataFrame.unionByName, barred) if barred else None

    def schema(self, fields: str) -> tuple[str, pa.Schema]:
        text = fields.format(qid=f"qid {self.qid}", doc=f"doc_id {self.doc}")
        return text, self.spark.createDataFrame([], text).toArrow().schema

    def applied(self, function, fields: str, needed: DataFrame, work: DataFrame, *options) -> DataFrame:
        """``function`` on each slice's needed blocks and its work, a bounded number of queries at a time."""
        schema, arrow = self.schema(fields)
        group = F.pmod(F.xxhash64("qid"), F.lit(self.groups)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("queries")
        left = self.blocks.join(needed.distinct(), needed.columns, "left_semi").select(
            "slice", "term", "docs", "values", "lens", copies)
        right = work.withColumn("queries", group)
        if self.barred is not None:
            right = right.unionByName(self.barred.select("slice", "doc_id", copies), allowMissingColumns=True)
        keys = ("slice", "queries")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            function(self.impact, *options, arrow), schema)


_PARTIAL = "{qid}, slice int, {doc}, partial double"


def planned(
    asked: DataFrame, parts: Sequence[Part], impact: Impact, k: int, exclude_self: bool = False,
    lead_postings: int = LEAD_POSTINGS, asked_at_once: int = ASKED_AT_ONCE, open_at_once: int = OPEN_AT_ONCE,
) -> Search:
    """A search for ``asked(qid, term, weight, most, df)``, one row per query and term; null is no query.

    ``most`` is what the term can add to a document's score at most, ``df`` its number of
    postings. ``asked`` is read several times and has to be a written table.
    """
    by_term = asked.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("df"))
    n_asked, n_postings = by_term.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
    at = _Opened(asked, parts, impact, max(1, -(-n_asked // asked_at_once)))
    if n_postings <= open_at_once:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(at.slices - 1))).alias("slice")
        work = asked.select("qid", "term", "weight", F.lit(0.0).alias("rest"), F.lit(0.0).alias("bound"), everywhere)
        found = at.applied(_survivors, _PARTIAL, asked.select("term"), work, k, exclude_self)
        return Search(found.select("qid", "doc_id", F.col("partial").alias("score")), asked)
    return _bounded(asked, at, k, exclude_self, lead_postings)


def _bounded(asked: DataFrame, at: _Opened, k: int, exclude_self: bool, lead_postings: int) -> Search:
    where = written(
        at.blocks.select("term", "slice").join(asked.select("term").distinct(), "term", "left_semi"), "block-places")
    by_most = Window.partitionBy("qid").orderBy(F.desc("most"), "term")
    before = F.coalesce(F.sum("df").over(by_most.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = written(asked.withColumn("_before", before).where(F.col("_before") <= lead_postings), "lead-terms")
    partial = at.applied(
        _thresholds, "{qid}, partial double", lead.select("term"),
        lead.select("qid", "term", "weight").join(where, "term"), k, exclude_self)
    best = first_per_group(partial, ["qid"], [F.desc("partial")], k, rank="_rank")
    bounds = written(best.where(F.col("_rank") == k).select("qid", F.col("partial").alias("bound")), "bounds")

    least_first = Window.partitionBy("qid").orderBy("most", F.desc("term"))
    up_to = F.sum("most").over(least_first.rowsBetween(Window.unboundedPreceding, 0))
    marked = asked.join(bounds, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))).withColumn(
        "out", up_to < LEFT_OUT * F.col("bound") - MARGIN)
    rest = F.sum(F.when(F.col("out"), F.col("most")).otherwise(0.0)).over(Window.partitionBy("qid"))
    marked = written(marked.withColumn("rest", rest), "marked-terms")
    essential, left_out = marked.where("NOT out"), marked.where("out")

    found = written(
        at.applied(
            _survivors, _PARTIAL, essential.select("term"),
            essential.select("qid", "term", "weight", "rest", "bound").join(where, "term"), k, exclude_self),
        "survivors")
    # The k-th best sum over all slices is a bound too, often a better one.
    best = first_per_group(found, ["qid"], [F.desc("partial"), "doc_id"], k, rank="_rank")
    better = best.where(F.col("_rank") == k).select("qid", F.col("partial").alias("reached"))
    limits = marked.select("qid", "rest").distinct().join(better, "qid", "left")
    survivors = written(
        found.join(limits, "qid").where(
            F.col("partial") + F.col("rest") >= F.coalesce("reached", F.lit(0.0)) - MARGIN).drop("reached"),
        "survivors-left")

    done = survivors.where("rest = 0").select("qid", "doc_id", F.col("partial").alias("score"))
    open_ = survivors.where("rest > 0")
    places = open_.select("qid", "slice").distinct()
    completing = written(
        left_out.select("qid", "term", "weight").join(places, "qid").join(where, ["term", "slice"]), "completing-terms")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    work = completing.select("qid", "slice", "term", "weight", none("doc_id", at.doc)).unionByName(
        open_.select("qid", "slice", none("term", "string"), F.col("partial").alias("weight"), "doc_id"))
    more = at.applied(_completed, "{qid}, {doc}, score double", completing.select("term", "slice"), work)
    return Search(done.unionByName(more), essential, left_out, survivors, completing)
