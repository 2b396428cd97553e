"""Near-duplicates by 64-bit SimHash, compared exactly in tiles.

Two fingerprints that differ in at most ``radius`` bits agree in at least one of
``radius + 1`` bands. Distinct fingerprints are dealt out by band value and sorted by
population count; numpy compares a tile with a tile by exclusive-or and bit count and
skips tile pairs whose population counts differ by more than the radius, which no link
can span. A band value that holds many fingerprints is cut into pieces by population
count, and each pair of pieces within the radius is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from casegrain.llm.components import connected_components
from casegrain.llm.shared import column, partitions, whole_row
from casegrain.workspace import written

SEED = 42
RADIUS = 3
TILE = 256
PIECE = 4096
AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 ``text``: A-Z lower-cased, words between ASCII blanks, word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        sizes = list(map(len, words))
        starts = list(accumulate((n + 1 for n in sizes), initial=0))
        ends = [a + n for a, n in zip(starts[shingle - 1:], sizes[shingle - 1:])]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = np.array(hashes[at: at + AT_ONCE], ">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.array(found.view(np.int64))

    return fingerprints


def linked(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two tiles whose fingerprints differ in at most ``radius`` bits."""
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def local_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that has a link here, and the smallest one it is connected to here."""
    values = np.unique(values)
    counts = np.bitwise_count(values).astype(np.int64)
    order = np.argsort(counts, kind="stable")
    tiles = [order[i: i + TILE] for i in range(0, len(order), TILE)]
    parent = np.arange(len(values))
    for a, one in enumerate(tiles):
        for other in tiles[a:]:
            if counts[other[0]] - counts[one[-1]] > radius:
                break
            i, j = linked(values[one], values[other], radius)
            pairs = np.unique(np.stack([parent[one[i]], parent[other[j]]]), axis=1)
            for x, y in pairs[:, pairs[0] != pairs[1]].T:
                x, y = sorted((_root(parent, x), _root(parent, y)))
                parent[y] = x
            roots = parent
            while (roots[roots] != roots).any():
                roots = roots[roots]
            parent = roots.copy()
    moved = np.flatnonzero(parent != np.arange(len(values)))
    return values[moved], values[parent[moved]]


def _links(radius: int):
    """Rows sorted by group in; a star of links per component of each group out."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        found, root = local_links(np.concatenate(parts), radius)
        return pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(root.view(np.int64))], names=["src", "dst"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.asarray(batch.column(0))
            values = np.asarray(batch.column(1)).view(np.uint64)
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                # Small groups share a tile: a link between two groups is a link as well.
                if rows >= TILE and group[a] != last:
                    yield flush(held)
                    held, rows = [], 0
                held.append(values[a:b])
                rows, last = rows + b - a, group[a]
        if held:
            yield flush(held)

    return links


def _pieces(bands: DataFrame, radius: int) -> DataFrame:
    """Crowded bands cut by population count into pieces; a row per pair of pieces it is in."""
    parts = (
        bands.groupBy("band", "ones").agg(F.count("*").alias("n"))
        .withColumn("salts", F.ceil(F.col("n") / PIECE).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("band", "ones", "salt", "salts")
    )
    one, other = parts.alias("one"), parts.alias("other")
    pairs = one.join(
        other,
        (F.col("one.band") == F.col("other.band"))
        & F.col("other.ones").between(F.col("one.ones"), F.col("one.ones") + radius)
        & ((F.col("other.ones") > F.col("one.ones")) | (F.col("other.salt") >= F.col("one.salt"))),
    )
    member = F.explode(F.array_distinct(F.array(
        F.struct("one.ones", "one.salt", "one.salts"), F.struct("other.ones", "other.salt", "other.salts"))))
    tasks = pairs.select(
        F.col("one.band").alias("band"),
        F.xxhash64("one.band", "one.ones", "one.salt", "other.ones", "other.salt").alias("group"),
        member.alias("piece"),
    ).select("band", "group", "piece.*")
    salted = bands.withColumn("hash", F.xxhash64("value"))
    return salted.join(tasks, ["band", "ones"]).where(
        F.pmod("hash", F.col("salts")) == F.col("salt")
    ).select("group", "value")


def near_classes(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``value, component`` (the smallest signed fingerprint) for each distinct value with a link."""
    spark = values.sparkSession
    distinct = written(values.select("value").distinct(), "fingerprints")
    width = 64 // (radius + 1)
    edges = [width * i for i in range(radius + 1)] + [64]
    band = F.explode(F.array(*[
        F.xxhash64(
            F.lit(i),
            F.shiftrightunsigned("value", low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1)),
        )
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]))
    bands = distinct.select("value", F.bit_count("value").alias("ones"), band.alias("band"))
    crowded = written(
        bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 2 * PIECE).select("band"),
        "crowded-bands",
    )
    usual = bands.join(crowded, "band", "left_anti").select(F.col("band").alias("group"), "value")
    cut = _pieces(bands.join(crowded, "band", "left_semi"), radius)
    links = (
        usual.unionByName(cut)
        .repartition(partitions(spark), "group").sortWithinPartitions("group")
        .mapInArrow(_links(radius), "src long, dst long")
    )
    return connected_components(links).select(F.col("node").alias("value"), "component")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document.

    Null is the empty text, with fingerprint zero like any text without words. The component
    is the smallest id reachable over links, the document's own included; null only where no
    id is known. Equal fingerprints are one node, so copies are never compared. An empty
    table gives no rows.
    """
    prints = written(
        docs.select(
            column(id_col).cast("long").alias("doc_id"),
            _fingerprints(shingle)(F.coalesce(column(text_col), F.lit(""))).alias("value"),
        ),
        "prints",
    )
    return _classes(prints, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` with the class each document is in."""
    classes = written(near_classes(prints, radius), "classes")
    ids = prints.groupBy("value").agg(F.min("doc_id").alias("low"))
    named = ids.join(classes, "value", "left").withColumn("component", F.coalesce("component", "value"))
    smallest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_value = written(
        named.select("value", "component").join(smallest, "component")
        .select("value", "component", "component_id"),
        "class-ids",
    )
    return prints.join(by_value, "value")


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS
) -> DataFrame:
    """One document of each class stays: the smallest id, null last, of equal ids the first row.

    Null is the empty text. All columns ride along, whatever their names; an empty table stays empty.
    """
    rows = written(
        docs.select(
            whole_row(docs).alias("row"), column(id_col).cast("long").alias("doc_id"),
            _fingerprints(shingle)(F.coalesce(column(text_col), F.lit(""))).alias("value"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "fingerprinted",
    )
    classes = _classes(rows.select("doc_id", "value", "number"), radius)
    first = classes.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "number")).alias("first")
    )
    dropped = written(
        rows.select("number").join(first.select(F.col("first.number").alias("number")), "number", "left_anti"),
        "near-copies",
    )
    return rows.join(dropped, "number", "left_anti").select("row.*")
