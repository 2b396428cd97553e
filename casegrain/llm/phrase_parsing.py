"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, phrases into longer phrases, and so on.
Boundaries come from deterministic coin tossing: each symbol is compared with its left
neighbour, and the place and value of the lowest differing bit becomes its new, much
smaller symbol; after a few rounds the local minima of the small symbols start phrases.
Runs of one symbol are taken together before that. A boundary therefore depends on a few
symbols around it only, and equal substrings get equal phrase names in their interior,
at any offset.

The fingerprint of a document is a MinHash sketch of the phrase names of its upper
levels; likeness is the share of sketch places that agree.

Neighbours in id order are found by one range shuffle: each partition works through its
sorted documents, and only its first and its last one are matched with other partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm.shared import partitions, plain
from casegrain.workspace import written

#: Levels whose phrase names enter the sketch: phrases of some 10 and some 30 code points.
LEVELS = (2, 3)
PLACES = 64
EMPTY = 0xFFFF
ROUNDS = 4
#: Code points parsed at a time; bounds the memory of a task beside its longest document.
AT_ONCE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def names_of(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Name of each phrase: a hash of the names in it, in order."""
    sizes = np.diff(np.append(starts, len(names)))
    place = np.arange(len(names)) - np.repeat(starts, sizes)
    part = mix(names + _ODD * (place.astype(np.uint64) + np.uint64(1)))
    return mix(np.add.reduceat(part, starts) + sizes.astype(np.uint64))


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)


def phrase_starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which symbols start a phrase. ``first`` marks the first symbol of each text.

    Neighbouring symbols differ, but across texts; a text's first symbol always starts one.
    """
    small = names
    for _ in range(ROUNDS):
        left = np.concatenate([small[:1], small[:-1]])
        bit = _lowest_bit(small ^ left)
        tossed = np.uint64(2) * bit + ((small >> np.minimum(bit, np.uint64(63))) & np.uint64(1))
        small = np.where(first, small & np.uint64(1), tossed)
    left = np.concatenate([small[:1], small[:-1]])
    right = np.concatenate([small[1:], small[-1:]])
    last = np.concatenate([first[1:], [True]])
    minimum = (small < left) & ((small < right) | last)
    after_first = np.concatenate([[False], first[:-1]])
    # A minimum right after a text's first symbol would leave that one alone in a phrase.
    return first | (minimum & ~after_first)


def parse(names: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: runs of a symbol become one symbol, then phrases. ``text_of`` is sorted."""
    first = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    runs = np.flatnonzero(first | np.concatenate([[True], names[1:] != names[:-1]]))
    sizes = np.diff(np.append(runs, len(names))).astype(np.uint64)
    names = np.where(sizes > 1, mix(names[runs] + _ODD * sizes), names[runs])
    text_of = text_of[runs]
    first = first[runs]
    starts = np.flatnonzero(phrase_starts(names, first))
    return names_of(names, starts), text_of[starts]


def sketches(texts: Sequence[str], levels: Sequence[int] = LEVELS) -> np.ndarray:
    """A row of ``PLACES`` 16-bit values per text; ``EMPTY`` where no phrase fell."""
    found = np.full((len(texts), PLACES), EMPTY, np.uint16)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return found
    names = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + _ODD)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    chosen = []
    for level in range(1, max(levels) + 1):
        names, text_of = parse(names, text_of)
        if level in levels:
            chosen.append((mix(names + np.uint64(level)), text_of))
    names, text_of = (np.concatenate(part) for part in zip(*chosen))
    place = text_of * PLACES + (names % np.uint64(PLACES)).astype(np.int64)
    value = np.minimum((mix(names + np.uint64(1)) >> np.uint64(48)), np.uint64(EMPTY - 1)).astype(np.uint16)
    order = np.lexsort((value, place))
    place, value = place[order], value[order]
    lowest = np.concatenate([[True], place[1:] != place[:-1]])
    found.ravel()[place[lowest]] = value[lowest]
    return found


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of places in use where two sketches agree, row by row; 1 for two empty ones."""
    used = (one != EMPTY) | (other != EMPTY)
    same = used & (one == other)
    total = used.sum(axis=-1, dtype=np.int64)
    return np.where(total > 0, same.sum(axis=-1, dtype=np.int64) / np.maximum(total, 1), 1.0)


def as_text(sketch: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 levels: Sequence[int] = LEVELS) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` per row; null is the empty text. No row leaves its partition."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _portions(texts):
                part = texts[a:b]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(map(len, part), pa.int64()),
                     pa.array(as_text(sketches(part, levels)))],
                    names=["doc_id", "n_chars", "fingerprint"])

    return plain(docs, id_col, text_col).mapInArrow(found, "doc_id long, n_chars long, fingerprint string")


def _portions(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Cuts a batch where ``AT_ONCE`` code points are reached."""
    a, held = 0, 0
    for b, text in enumerate(texts):
        if held and held + len(text) > AT_ONCE:
            yield a, b
            a, held = b, 0
        held += len(text)
    if a < len(texts):
        yield a, len(texts)


COMPARED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
COMPARED_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                "edited_fingerprint string, near_edited double, near_next double")
#: What a partition leaves to match: its first document, wanted by the one before, and its last.
ENDS_DDL = ", part int, end string, text string"


def _sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.uint16)


def _compared(ids: list, texts: list[str], own: np.ndarray, following: list[str], nexts: np.ndarray,
              levels: Sequence[int]) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    other = sketches(changed, levels)
    return [
        pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(as_text(own)), pa.array(as_text(other)),
        pa.array(likeness(own, other)), pa.array(likeness(own, nexts)),
    ]


def _neighbours(levels: Sequence[int]):
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [*COMPARED.names, "part", "end", "text"]
        kinds = [*COMPARED.types, pa.int32(), pa.string(), pa.string()]
        last: tuple | None = None

        def end(kind: str, doc_id, text: str, sketch: np.ndarray) -> pa.RecordBatch:
            values = [doc_id, None, None, as_text(sketch)[0], None, None, None, part, kind, text]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _portions(all_texts):
                ids, texts = all_ids[a:b], all_texts[a:b]
                own = sketches(texts, levels)
                if last is None:
                    yield end("first", ids[0], texts[0], own[:1])
                else:
                    ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
                last = (ids[-1], texts[-1], own[-1:])
                if len(ids) > 1:
                    n = len(ids) - 1
                    columns = _compared(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:], levels)
                    columns += [pa.nulls(n, k) for k in kinds[-3:]]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        if last is not None:
            yield end("last", *last)

    return neighbours


def _matched(levels: Sequence[int]):
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, prints, following, nexts = (c.to_pylist() for c in batch.columns)
            if ids:
                own, other = (np.stack([_sketch_of(x) for x in part]) for part in (prints, nexts))
                yield pa.RecordBatch.from_arrays(
                    _compared(ids, texts, own, following, other, levels), schema=COMPARED)

    return matched


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        levels: Sequence[int] = LEVELS) -> DataFrame:
    """Every document beside its edited text and the next document in descending id order.

    The edited text has its last third replaced by the beginning of the next document; the
    first follows the last. Rows that agree in their id are ordered by a hash of the text, a
    null id comes last, null is the empty text. A single document is its own next one, an
    empty table gives no rows, and other columns stay behind.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    done = written(
        plain(docs, id_col, text_col)
        .repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        .mapInArrow(_neighbours(levels), COMPARED_DDL + ENDS_DDL),
        "neighbours",
    )
    ends = done.where("end IS NOT NULL").select("doc_id", "fingerprint", "part", "end", "text")
    parts = sorted(r["part"] for r in ends.where("end = 'first'").select("part").collect())
    complete = done.where("end IS NULL").select(*COMPARED.names)
    if not parts:
        return complete
    # One pair of numbers per partition: which partition's first document follows its last.
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = ends.where("end = 'first'").select(
        F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))
    open_ = ends.where("end = 'last'").join(after, "part").join(first, "next_part").select(
        "doc_id", "text", "fingerprint", "following", "next_print")
    return complete.unionByName(open_.mapInArrow(_matched(levels), COMPARED_DDL))
