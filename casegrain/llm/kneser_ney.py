"""Interpolated modified Kneser-Ney model: counted in Spark, memory-mapped to score.

Counting: each partition hashes its words, sorts its n-grams, and sends one block of
distinct n-grams and counts per shard (a range of n-gram hashes). A shard's task adds
the blocks up, saves its n-grams as a sorted array of hashes beside an array of counts,
and passes on what the lower order needs: for each context its total and how many n-grams
follow once, twice, or more; for each suffix the number of different words before it.
Those go through the same merge, order by order. As shards are ranges, their arrays end
to end are one sorted array: each is copied to its place in one file.

Scoring: workers map the arrays of the shared folder into memory and look up the sorted
hashes of many documents at a time; nothing is shuffled, and no worker holds the model.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from casegrain.llm.shared import column, mounted_folder, partitions, plain, remainder
from casegrain.workspace import written

ORDER = 2
#: Marks no word can equal, as words hold no blanks.
END = np.uint64(xxh64_intdigest(b" "))
BEGIN = np.uint64(xxh64_intdigest(b"  "))
#: Bytes of text a task hashes or scores at a time, tokens it counts together, and tokens per shard.
BYTES_AT_ONCE = 3 << 20
COUNTED_TOGETHER = 1 << 20
PER_SHARD = 1 << 20
#: Words are told apart by 48 bits inside n-grams; single words' own counts keep all 64.
WORD_BYTES = 6
WORD_MASK = np.uint64((1 << 8 * WORD_BYTES) - 1)
#: An n-gram's hash begins with bits of its last word, then of the words before: a context's n-grams
#: lie in few shards, and a frequent context still in several.
LAST_BITS, CONTEXT_BITS = 3, 13

BLOCK = pa.schema([
    ("kind", pa.string()), ("level", pa.int32()), ("shard", pa.int32()),
    ("words", pa.list_(pa.binary())), ("counts", pa.binary()),
])
BLOCK_DDL = "kind string, level int, shard int, words array<binary>, counts binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of word hashes; different for different lengths."""
    found = np.full(len(words[0]), len(words), np.uint64)
    for hashes in words:
        before, found = found, _mix(found * np.uint64(0x9E3779B97F4A7C15) + hashes)
    if len(words) == 1:
        return found
    rest = 64 - LAST_BITS - CONTEXT_BITS
    last = _mix(words[-1]) >> np.uint64(64 - LAST_BITS) << np.uint64(64 - LAST_BITS)
    context = before >> np.uint64(64 - CONTEXT_BITS) << np.uint64(rest)
    return last | context | found & np.uint64((1 << rest) - 1)


@dataclass
class Tokens:
    """The tokens of some documents: words (A-Z lower-cased, between ASCII blanks), then an end each.

    ``words`` are full hashes; ``grams`` the shorter ones of each token and its ``order - 1``
    predecessors; ``starts`` says where each document's tokens begin.
    """

    words: np.ndarray
    grams: list[np.ndarray]
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], order: int) -> Tokens:
        lists = [text.lower().split() for text in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        words = np.empty(starts[-1], np.uint64)
        ends = np.zeros(len(words), bool)
        ends[starts[1:] - 1] = True
        words[ends] = END
        words[~ends] = np.fromiter(
            map(xxh64_intdigest, chain.from_iterable(lists)), np.uint64, len(words) - len(lists))
        marked = np.full(len(words) + len(lists) * (order - 1), BEGIN & WORD_MASK)
        token = np.arange(len(words)) + np.repeat((np.arange(len(lists)) + 1) * (order - 1), sizes)
        marked[token] = words & WORD_MASK
        return cls(words, [marked[token - back] for back in range(order - 1, -1, -1)], starts)


def portions(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of some ``BYTES_AT_ONCE``, with their texts."""
    for batch in batches:
        texts = batch.column(place).cast(pa.binary()).to_pylist()
        a, held = 0, 0
        for b, text in enumerate(texts):
            if held and held + len(text) > BYTES_AT_ONCE:
                yield batch.slice(a, b - a), texts[a:b]
                a, held = b, 0
            held += len(text)
        if a < len(texts):
            yield batch.slice(a, len(texts) - a), texts[a:]


def _distinct(words: list[np.ndarray], weights: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes in order, their words, and their counts (or summed rows of weights)."""
    hashes = gram_hash(words)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else order
    if weights is None:
        counts = np.diff(np.append(first, len(hashes)))
    else:
        counts = np.add.reduceat(weights[order], first, axis=0) if len(hashes) else weights
    return hashes[first], [w[order[first]] for w in words], counts


def _shards_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _packed(words: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each hash, compressed."""
    return ZstdCompressor(1).compress(words.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())


def _unpacked(data: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8).reshape(-1, width)
    words = np.zeros((len(parts), 8), np.uint8)
    words[:, :width] = parts
    return words.view(np.uint64).ravel()


def _numbers(counts: np.ndarray) -> bytes:
    return ZstdCompressor(1).compress(counts.astype("<i8").tobytes())


def _as_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(ZstdDecompressor().decompress(data), "<i8")


def _width(kind: str) -> int:
    return WORD_BYTES if kind == "gram" else 8


def _blocks(kind: str, level: int, words: list[np.ndarray], counts: np.ndarray, bits: int) -> list[tuple]:
    """One block per shard, ordered by first word, so that equal words stand together."""
    shard = _shards_of(gram_hash(words), bits)
    order = np.lexsort((words[0], shard))
    shard, counts = shard[order], counts[order]
    words = [w[order] for w in words]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    edges = [0, *cuts.tolist(), len(shard)] if len(shard) else [0]
    return [
        (kind, level, int(shard[a]), [_packed(w[a:b], _width(kind)) for w in words],
         _numbers(counts[a:b]))
        for a, b in zip(edges, edges[1:])
    ]


def _batch(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(BLOCK)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, BLOCK)], schema=BLOCK)


def _count(order: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            single, *grams = map(np.concatenate, zip(*held))
            for kind, words in (("raw", [single]), ("gram", grams)):
                _, words, counts = _distinct(words, None)
                yield from _batch(_blocks(kind, len(words), words, counts, bits)).to_batches()

        for _, texts in portions(batches, 0):
            tokens = Tokens.of(texts, order)
            held.append([tokens.words, *tokens.grams])
            size += len(tokens.words)
            if size >= COUNTED_TOGETHER:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    return count


def _smallest_type(most: int) -> str:
    """The smallest unsigned type that holds a number."""
    return next(t for t in ("u1", "u2", "u4", "u8") if most <= np.iinfo(t).max)


def _save(folder: str, name: str, shard: int, keys: np.ndarray, values: np.ndarray) -> tuple:
    """Saves two arrays of a shard, each under its final name at once, so that a repeated task does
    no harm; gives the row that says so: name, shard, number of keys, largest value."""
    most = int(values.max())
    for part, array in (("keys", keys), ("values", values.astype(_smallest_type(most)))):
        final = f"{folder}/{name}-{shard:06d}-{part}.npy"
        attempt = f"{final}.{os.getpid()}"
        with open(attempt, "wb") as out:
            np.save(out, array)
        os.replace(attempt, final)
    return ("saved", 0, shard, [name.encode()], _numbers(np.array([len(keys), most])))


def _place(folder: str):
    """Copies shards' arrays to their places in one file per name, and removes them."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = f"{folder}/{row['name']}-{row['shard']:06d}-{row['part']}.npy"
                # Removed only when its copy is safe: a repeated task finds nothing left to do.
                if os.path.exists(source):
                    array = np.load(source, mmap_mode="r").astype(row["type"])
                    with open(f"{folder}/{row['name']}-{row['part']}", "r+b") as out:
                        out.seek(row["at"] * array.itemsize)
                        array.tofile(out)
                        out.flush()
                        os.fsync(out.fileno())
                    os.remove(source)
            yield batch.select(["shard"])

    return place


def _joined(spark: SparkSession, folder: str, saved: list[tuple[str, int, int, int]]) -> dict[str, str]:
    """One sorted array of keys and one of values per name; gives the values' types by name."""
    types, places = {}, []
    for name in sorted({s[0] for s in saved}):
        shards = sorted(s[1:] for s in saved if s[0] == name)
        width = 4 if name.startswith("context") else 1
        types[name] = _smallest_type(max(most for _, _, most in shards))
        at = 0
        for shard, n, _ in shards:
            places.append((name, shard, "keys", "u8", at))
            places.append((name, shard, "values", types[name], at * width))
            at += n
        for part, size in (("keys", 8), ("values", width * np.dtype(types[name]).itemsize)):
            with open(f"{folder}/{name}-{part}", "wb") as out:
                out.truncate(at * size)
    if places:
        rows = spark.createDataFrame(places, "name string, shard int, part string, type string, at long")
        rows.repartition(partitions(spark)).mapInArrow(_place(folder), "shard int").count()
    return types


def _merge(folder: str, bits: int):
    """Adds up the blocks of one (kind, level, shard), saves them, passes on the lower order."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, level, shard = (k.as_py() for k in key)
        width = 1 if kind == "context" else level
        words = [
            np.concatenate([_unpacked(w[i].as_py(), _width(kind)) for w in table["words"]])
            for i in range(width)
        ]
        counts = np.concatenate([_as_numbers(c.as_py()) for c in table["counts"]])
        if kind == "context":
            # A context's row: total, and how many n-grams follow once, twice, more often.
            order = np.argsort(words[0], kind="stable")
            sorted_ = words[0][order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            sums = np.add.reduceat(counts.reshape(-1, 4)[order], first, axis=0)
            return _batch([_save(folder, f"context{level}", shard, sorted_[first], sums)])
        hashes, words, counts = _distinct(words, counts)
        saved = _save(folder, f"{kind}{level}", shard, hashes, counts)
        seen = [int((counts == n).sum()) for n in (1, 2, 3, 4)]
        rows = [saved, ("stats", level, 0, [kind.encode()],
                 _numbers(np.array([*seen, counts.sum(), len(counts)])))]
        if kind == "gram" and level > 1:
            followed = np.stack([counts, counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64)
            context = gram_hash(words[:-1])
            order = np.argsort(context, kind="stable")
            sorted_ = context[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            rows += _context_blocks(level, sorted_[first], np.add.reduceat(followed[order], first, axis=0), bits)
            _, suffix, types = _distinct(words[1:], None)
            rows += _blocks("gram", level - 1, suffix, types.astype(np.int64), bits)
        return _batch(rows)

    return merge


def _context_blocks(level: int, contexts: np.ndarray, sums: np.ndarray, bits: int) -> list[tuple]:
    shard = _shards_of(contexts, bits)
    edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    return [("context", level, int(shard[a]), [_packed(contexts[a:b], 8)], _numbers(sums[a:b]))
            for a, b in zip(edges, edges[1:])]


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2, and 3 or more, from how many n-grams have counts 1 to 4.

    Where a count of counts is 0 the formula has no value; half of the count's step is taken then.
    """
    n1, n2, n3, n4 = (int(x) for x in n[:4])
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else 0.5
    d3 = 3 - 4 * y * n4 / n3 if n3 else 0.5
    return tuple(d if 0 < d < i + 1 else 0.5 for i, d in enumerate((d1, d2, d3)))


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that hold for all n-grams."""

    folder: str
    order: int
    types: dict[str, str]
    tokens: int
    distinct: int
    stats: dict[int, list[int]]

    def lookup(self, name: str, hashes: np.ndarray, width: int = 1) -> np.ndarray:
        """The values saved for each hash, zeros for unknown ones."""
        wanted, place = np.unique(hashes, return_inverse=True)
        found = np.zeros((len(wanted), width), np.int64)
        if name in self.types:
            keys, values = _mapped(self.folder, name, self.types[name], width)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == wanted)
            found[hit] = values[at[hit]]
        return found[place]

    def probabilities(self, grams: list[np.ndarray]) -> np.ndarray:
        """P(last word | words before) for each row of ``order`` word hashes."""
        p = np.full(len(grams[-1]), 1.0 / (self.distinct + 1))
        for level in range(1, self.order + 1):
            stats = self.stats.get(level)
            if stats is None or not stats[5]:
                continue
            taken = np.array([0.0, *discounts(np.array(stats))])
            words = grams[self.order - level:]
            count = self.lookup(f"gram{level}", gram_hash(words))[:, 0]
            if level == 1:
                total = np.full(len(p), stats[4])
                more = stats[5] - stats[0] - stats[1]
                followed = np.broadcast_to(np.array([stats[0], stats[1], more]), (len(p), 3))
            else:
                rows = self.lookup(f"context{level}", gram_hash(words[:-1]), 4)
                total, followed = rows[:, 0], rows[:, 1:]
            known = total > 0
            safe = np.where(known, total, 1)
            kept = np.maximum(count - taken[np.minimum(count, 3)], 0.0) / safe
            left = followed @ taken[1:] / safe
            p = np.where(known, kept + left * p, p)
        return p


@lru_cache(maxsize=16)
def _mapped(folder: str, name: str, kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.memmap(f"{folder}/{name}-keys", "u8", "r")
    return keys, np.memmap(f"{folder}/{name}-values", kind, "r", shape=(len(keys), width))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count all whole texts of ``docs``; null is the empty text, whose only token is the end.

    Only the text column is read, so other columns cannot clash. An empty table trains nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(column(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LAST_BITS, (size // (6 * PER_SHARD)).bit_length())
    _, folder = mounted_folder(spark, "kneser-ney")
    stats: dict[tuple[str, int], np.ndarray] = {}
    saved = []
    blocks = texts.mapInArrow(_count(order, bits), BLOCK_DDL)
    for _ in range(order):
        merged = written(
            blocks.groupBy("kind", "level", "shard").applyInArrow(_merge(folder, bits), BLOCK_DDL), "ngrams")
        # Two short rows per shard come back.
        for row in merged.where("kind IN ('stats', 'saved')").collect():
            name, numbers = bytes(row["words"][0]).decode(), _as_numbers(bytes(row["counts"]))
            if row["kind"] == "saved":
                saved.append((name, row["shard"], *map(int, numbers)))
            else:
                stats[name, row["level"]] = stats.get((name, row["level"]), 0) + numbers
        blocks = merged.where("kind NOT IN ('stats', 'saved')")
    types = _joined(spark, folder, saved)
    raw = stats.get(("raw", 1), np.zeros(6, np.int64))
    return Model(folder, order, types, int(raw[4]), int(raw[5]),
                 {level: found.tolist() for (kind, level), found in stats.items() if kind == "gram"})


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` (log10) per row, ``perplexity`` beside them.

    ``base_score`` adds one to every word's count; ``score`` is the model's. Null is the empty
    text. Repeated rows score alike; with nothing trained every token has probability 1. Other
    columns stay behind; an empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 1):
            tokens = Tokens.of(texts, model.order)
            raw = model.lookup("raw1", gram_hash([tokens.words]))[:, 0]
            base = np.log10((raw + 1) / (model.tokens + model.distinct + 1))
            full = np.log10(model.probabilities(tokens.grams))
            first = tokens.starts[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(tokens.starts)),
                 pa.array(np.add.reduceat((raw > 0).astype(np.int64), first)),
                 pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(full, first))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = plain(docs, id_col, text_col).mapInArrow(score, SCORED)
    return rows.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 7) == 2
