"""Collocations: phrases whose words occur together more than apart, from counted automata.

Phrases of a shard are counted, sorted and added one by one to a minimal acyclic automaton
that maps each of them to its count (a count transducer). It is cut by ranges of phrases;
the owner of a range unites the shards' automata and sums the counts. A phrase can be
frequent only if its parts are, so words, pairs and longer phrases are counted in turn,
each time only those whose parts were frequent. What a candidate's parts count is looked
up by composing the automaton of all parts asked for with the counts of their range.

A path starts with the language, so one automaton serves all of them. Frequent parts travel
to the tasks as a bitmap of fixed size: what it lets through too much costs time, no result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from casegrain.llm.shared import column, partitions
from casegrain.operators.ranking import first_per_group
from casegrain.workspace import written

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
INSIDE = (80, 100)
MOST = 2_000
UNKNOWN = "und"
#: Words a task counts before it makes a shard of them, and counts it holds before it unites them.
SHARD_WORDS, HELD_COUNTS = 2_000_000, 2_000_000
FILTER_BITS = 1 << 24
#: Phrases that range bounds are taken from; bounds only spread the work.
BOUND_SAMPLE, OF_DOCUMENTS, PER_DOCUMENT = 20_000, 16, 8

Phrase = tuple[bytes, ...]

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(
    _BREAKS + b"\t" + bytes(range(ord("A"), ord("Z") + 1)),
    b"\n" * len(_BREAKS) + b" " + bytes(range(ord("a"), ord("z") + 1)))


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, with a line break where a piece ends: no phrase crosses one. Empty ones mean nothing."""
    return text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")


# --- Automata ---------------------------------------------------------------------

#: Arrays as bytes: Spark would copy array columns element by element, and ``symbols`` are those that end at ``ends``.
SCHEMA = "range int, " + ", ".join(f"{name} binary" for name in (
    "symbols", "ends", "starts", "labels", "targets", "final", "weights"))
_NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
_KINDS = (np.int32, np.int32, np.int32, np.int32, np.bool_, np.int64)


def _listed_names(symbols: pa.Array) -> list[bytes]:
    return symbols.to_numpy(zero_copy_only=False).tolist()


@dataclass(frozen=True)
class Counted:
    """Phrases and counts as arrays: row i has the symbols ``places[i]``, -1 after its end.

    Rows are sorted by symbol, a phrase before those it begins; ``symbols`` is sorted too.
    """

    symbols: pa.Array
    places: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, counted: Iterable[tuple[Phrase, int]]) -> Counted:
        rows = sorted(counted)
        symbols = sorted({symbol for phrase, _ in rows for symbol in phrase})
        number = {symbol: i for i, symbol in enumerate(symbols)}
        width = max((len(phrase) for phrase, _ in rows), default=0)
        places = np.full((len(rows), width), -1, np.int32)
        for i, (phrase, _) in enumerate(rows):
            places[i, : len(phrase)] = [number[symbol] for symbol in phrase]
        return cls(pa.array(symbols, pa.binary()), places, np.array([n for _, n in rows], np.int64))

    def phrase(self, i: int) -> Phrase:
        return tuple(self.symbols[x].as_py() for x in self.places[i].tolist() if x >= 0)

    def items(self) -> list[tuple[Phrase, int]]:
        names = _listed_names(self.symbols)
        return [(tuple(names[x] for x in row if x >= 0), n)
                for row, n in zip(self.places.tolist(), self.counts.tolist())]

    def part(self, start: int, end: int) -> Counted:
        """Some of the rows, with the symbols they need."""
        places = self.places[start:end]
        found = np.zeros(len(self.symbols) + 1, bool)
        found[places] = True
        used = np.flatnonzero(found[:-1])
        place = np.full(len(self.symbols) + 1, -1, np.int32)
        place[used] = np.arange(len(used))
        return Counted(self.symbols.take(pa.array(used)), place[places], self.counts[start:end])


@dataclass(frozen=True)
class CountTransducer:
    """A minimal acyclic automaton; the i-th phrase it accepts, in sorted order, has ``weights[i]``.

    State s has the arcs ``starts[s]`` to ``starts[s + 1]``, in order of their symbols; its
    targets have lower numbers, and the last state is the start. Equal endings are one state,
    whatever their counts are.
    """

    symbols: pa.Array
    starts: np.ndarray
    labels: np.ndarray
    targets: np.ndarray
    final: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, counted: Counted) -> CountTransducer:
        """Built from sorted phrases: a prefix whose last phrase is in becomes a state, or the one equal to it."""
        places, (rows, width) = counted.places, counted.places.shape
        sizes = (places >= 0).sum(axis=1)
        # The first place in which a row differs from the one before it opens its new prefixes.
        differs = np.argmax(np.concatenate([np.ones((min(rows, 1), width + 1), bool), np.concatenate(
            [places[1:] != places[:-1], np.ones((max(rows - 1, 0), 1), bool)], axis=1)]), axis=1)
        known: dict[tuple[bool, bytes, bytes], int] = {}
        arcs: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.zeros(0, np.int32)

        def state(final: bool, labels: np.ndarray, targets: np.ndarray) -> int:
            key = final, labels.tobytes(), targets.tobytes()
            if (found := known.get(key)) is None:
                found = known[key] = len(arcs)
                arcs.append((labels, targets))
            return found

        below, below_states = np.zeros(0, np.int64), none
        for depth in range(width, -1, -1):
            opened = np.flatnonzero((differs < depth) & (sizes >= depth)) if depth else np.zeros(1, np.int64)
            final = sizes[opened] == depth if rows else np.zeros(1, bool)
            states = np.full(len(opened), -1, np.int32)
            edges = np.append(np.searchsorted(below, opened), len(below))
            ends = edges[:-1] == edges[1:]
            if ends.any():
                states[ends] = state(True, none, none) if rows else state(False, none, none)
            labels = places[below, depth].astype(np.int32) if len(below) else none
            for i in np.flatnonzero(~ends).tolist():
                one, end = edges[i], edges[i + 1]
                states[i] = state(bool(final[i]), labels[one:end], below_states[one:end])
            below, below_states = opened, states
        starts = np.cumsum([0, *(len(labels) for labels, _ in arcs)]).astype(np.int32)
        join = lambda i: np.concatenate([none, *(a[i] for a in arcs)])
        return cls(counted.symbols, starts, join(0), join(1), np.array([k[0] for k in known]), counted.counts)

    def accepted(self) -> np.ndarray:
        """Phrases accepted from each state."""
        out: list[int] = []
        starts, targets = self.starts.tolist(), self.targets.tolist()
        for state, final in enumerate(self.final.tolist()):
            out.append(final + sum(map(out.__getitem__, targets[starts[state]: starts[state + 1]])))
        return np.array(out, np.int64)

    def _before(self) -> np.ndarray:
        """For each arc, the phrases of its state that come before those through the arc."""
        below = np.append(0, np.cumsum(self.accepted()[self.targets]))
        state = np.repeat(np.arange(len(self.final)), np.diff(self.starts))
        return below[:-1] - below[self.starts[state]] + self.final[state]

    def counted(self) -> Counted:
        """All phrases with their counts; all paths grow by a symbol at a time."""
        before = self._before()
        state, at = np.array([len(self.final) - 1]), np.zeros(1, np.int64)
        places = np.zeros((1, 0), np.int32)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(state):
            ends = self.final[state]
            found.append((at[ends], places[ends]))
            first, n = self.starts[state], self.starts[state + 1] - self.starts[state]
            row = np.repeat(np.arange(len(state)), n)
            arc = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
            state, at = self.targets[arc], at[row] + before[arc]
            places = np.concatenate([places[row], self.labels[arc][:, None]], axis=1)
        width = max(p.shape[1] for _, p in found)
        out = np.full((len(self.weights), width), -1, np.int32)
        for at, places in found:
            out[at, : places.shape[1]] = places
        return Counted(self.symbols, out, self.weights)

    def composed(self, other: CountTransducer) -> Iterator[tuple[Phrase, int]]:
        """Phrases both accept, with the count that ``other`` has; both are walked in step."""
        before, mine_of, names = other._before(), _listed_names(self.symbols), _listed_names(other.symbols)
        number = {symbol: i for i, symbol in enumerate(mine_of)}
        theirs_to_mine = [number.get(symbol, -1) for symbol in names]
        todo = [(len(self.final) - 1, len(other.final) - 1, 0, ())]
        while todo:
            mine, theirs, at, phrase = todo.pop()
            if other.final[theirs] and self.final[mine]:
                yield phrase, int(other.weights[at])
            one, end = self.starts[mine], self.starts[mine + 1]
            arcs = dict(zip(self.labels[one:end].tolist(), self.targets[one:end].tolist()))
            for arc in range(other.starts[theirs], other.starts[theirs + 1]) if arcs else ():
                label = other.labels[arc]
                target = arcs.get(theirs_to_mine[label])
                if target is not None:
                    todo.append((target, other.targets[arc], at + int(before[arc]), (*phrase, names[label])))


def united(transducers: Sequence[CountTransducer], least: int = 1) -> Counted:
    """The union's phrases with the sums of their counts, without those that are too rare.

    A phrase is sorted as few integers, each of as many symbols' places as its bits hold.
    """
    parts = [t.counted() for t in transducers]
    named = pa.concat_arrays([p.symbols for p in parts]).dictionary_encode()
    order = pc.sort_indices(named.dictionary)
    symbols, place = named.dictionary.take(order), np.zeros(len(order), np.int64)
    place[order.to_numpy()] = np.arange(1, len(order) + 1)
    place = place[named.indices.to_numpy()]
    width, bits = max(p.places.shape[1] for p in parts), max(1, len(symbols).bit_length())
    per_key = 63 // bits
    keys = np.zeros((-(-width // per_key), sum(len(p.counts) for p in parts)), np.int64)
    counts = np.concatenate([p.counts for p in parts])
    at = seen = 0
    for p in parts:
        # 0 where a phrase has ended.
        own = np.append(0, place[seen: seen + len(p.symbols)])
        for i in range(width):
            key = keys[i // per_key, at: at + len(p.counts)]
            key <<= bits
            if i < p.places.shape[1]:
                key |= own[p.places[:, i] + 1]
        at, seen = at + len(p.counts), seen + len(p.symbols)
    del parts
    order = np.lexsort(keys[::-1]) if width else np.arange(len(counts))
    keys, counts = keys[:, order], counts[order]
    first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(counts) else order
    sums = np.add.reduceat(counts, first) if len(first) else counts
    kept = sums >= least
    keys = keys[:, first[kept]]
    places = np.zeros((keys.shape[1], width), np.int32)
    for i in range(width - 1, -1, -1):
        places[:, i] = (keys[i // per_key] & (1 << bits) - 1) - 1
        keys[i // per_key] >>= bits
    return Counted(symbols, places, sums[kept]).part(0, len(places))


def _packed(range_: int, t: CountTransducer) -> pa.RecordBatch:
    ends = np.cumsum(pc.binary_length(t.symbols).to_numpy())
    arrays = (ends, t.starts, t.labels, t.targets, t.final, t.weights)
    values = (b"".join(_listed_names(t.symbols)), *(a.astype(kind).tobytes() for a, kind in zip(arrays, _KINDS)))
    return pa.RecordBatch.from_arrays(
        [pa.array([range_], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], _NAMES)


def _transducers(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, CountTransducer]]:
    columns = [batch.column(name) for name in _NAMES]
    for i in range(batch.num_rows):
        range_, symbols, *arrays = (c[i] for c in columns)
        # Copied, so that they lie as their kinds ask and the batch can go.
        ends, *arrays = (np.frombuffer(a.as_buffer(), kind).copy() for a, kind in zip(arrays, _KINDS))
        offsets = pa.py_buffer(np.append(np.int32(0), ends))
        yield range_.as_py(), CountTransducer(
            pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(symbols.as_py())]), *arrays)


def _by_range(counted: Counted, bounds: Sequence[Phrase]) -> Iterator[pa.RecordBatch]:
    """The phrases of one language as one transducer per range."""
    if not len(counted.counts):
        return
    rows = range(len(counted.counts))
    range_, start = bisect_right(bounds, counted.phrase(0)), 0
    while start < len(rows):
        end = bisect_left(rows, bounds[range_], lo=start, key=counted.phrase) if range_ < len(bounds) else len(rows)
        if end > start:
            yield _packed(range_, CountTransducer.of(counted.part(start, end)))
        range_, start = range_ + 1, end


# --- Counting ---------------------------------------------------------------------


class _Shard:
    """Some texts by language, ready to be split at blanks; a line break is a piece's end."""

    def __init__(self):
        self.texts: dict[bytes, list[bytes]] = {}
        self.size = 0

    def add(self, lang: bytes, text: bytes) -> None:
        plain = text.translate(_PLAIN)
        self.texts.setdefault(lang, []).append(plain)
        self.size += plain.count(b" ") + 2 * plain.count(b"\n") + 2

    def ranked(self) -> Iterator[tuple[bytes, list[bytes], np.ndarray]]:
        """Per language its sorted symbols, itself among them, and all words' places in that list, -1 after each piece."""
        for lang in sorted(self.texts):
            joined = b"\n".join([*self.texts[lang], b""]).replace(b"\n", b" \n ")
            # Words with the blank after them lie there as Arrow wants them; the few distinct ones are cut.
            ends = np.append(0, np.flatnonzero(np.frombuffer(joined, np.uint8) == ord(" ")) + 1)
            words = pa.Array.from_buffers(
                pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(joined)]).dictionary_encode()
            found, ids = pc.binary_slice(words.dictionary, 0, -1).cast(pa.binary()), words.indices.to_numpy()
            named = pc.not_equal(found, pa.scalar(b"", found.type))
            kept = pc.and_(named, pc.not_equal(found, pa.scalar(b"\n", found.type))).to_numpy(zero_copy_only=False)
            own = pa.array([lang], found.type)
            symbols = pc.unique(pa.concat_arrays([found.filter(pa.array(kept)), own]))
            symbols = symbols.take(pc.sort_indices(symbols))
            place = np.full(len(found), -1, np.int64)
            place[kept] = pc.index_in(found.filter(pa.array(kept)), value_set=symbols).to_numpy()
            yield lang, _listed_names(symbols), place[ids[named.to_numpy(zero_copy_only=False)[ids]]]


class _Frequent:
    """Frequent words and pairs as bits, by hashes that numpy combines; the bits may hold some others too."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    @staticmethod
    def hashes(lang: bytes, words: Sequence[bytes]) -> np.ndarray:
        return np.array([xxh64_intdigest(lang + b"\0" + w) for w in words], np.uint64)

    @staticmethod
    def of_pair(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        mixed = one * np.uint64(0x9E3779B97F4A7C15) + other
        return mixed ^ (mixed >> np.uint64(29))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _phrases(lang: bytes, symbols: list[bytes], columns: Sequence[np.ndarray], counts: np.ndarray) -> Counted:
    places = np.stack([np.full(len(counts), symbols.index(lang)), *columns], axis=1).astype(np.int32)
    return Counted(pa.array(symbols, pa.binary()), places, counts.astype(np.int64))


def _words(shard: _Shard, frequent: _Frequent | None) -> Iterator[Counted]:
    """Words, and as the phrase of the language alone the number of all words."""
    for lang, symbols, places in shard.ranked():
        counts = np.bincount(places[places >= 0], minlength=len(symbols))
        found = np.flatnonzero(counts)
        yield _phrases(lang, symbols, [np.append(-1, found)], np.append(counts.sum(), counts[found]))


def _pairs(shard: _Shard, frequent: _Frequent) -> Iterator[Counted]:
    """Pairs of frequent words."""
    for lang, symbols, places in shard.ranked():
        good = np.append(frequent.holds(frequent.hashes(lang, symbols)), False)
        places = np.where(good[places], places, -1)
        keys, counts = np.unique(
            (places[:-1] << 32 | places[1:])[(places[:-1] >= 0) & (places[1:] >= 0)], return_counts=True)
        yield _phrases(lang, symbols, [keys >> 32, keys & 0xFFFFFFFF], counts)


def _longer(shard: _Shard, frequent: _Frequent) -> Iterator[Counted]:
    """Longer phrases all of whose pairs are frequent."""
    for lang, symbols, places in shard.ranked():
        hashes = frequent.hashes(lang, symbols)
        places = np.where(np.append(frequent.holds(hashes), False)[places], places, -1)
        both = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
        pair_good = np.zeros(len(places) + LONGEST, bool)
        pair_good[both] = frequent.holds(frequent.of_pair(hashes[places[both]], hashes[places[both + 1]]))
        # The phrase that starts at a place, by its row in ``phrases``; it grows by the word after it.
        start = np.flatnonzero(pair_good[:-1] & pair_good[1:])
        keys, number = np.unique(places[start] << 32 | places[start + 1], return_inverse=True)
        phrases = np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1)
        phrase_at = np.zeros(len(places), np.int64)
        phrase_at[start] = number
        rows, sums = [], []
        for size in range(3, LONGEST + 1):
            start = start[pair_good[start + size - 2]]
            keys, number, counts = np.unique(
                phrase_at[start] << 32 | places[start + size - 1], return_inverse=True, return_counts=True)
            phrases = np.concatenate([phrases[keys >> 32], (keys & 0xFFFFFFFF)[:, None]], axis=1)
            phrase_at[start] = number
            rows.append(np.pad(phrases, ((0, 0), (0, LONGEST - size)), constant_values=-1))
            sums.append(counts)
        found, counts = np.concatenate(rows), np.concatenate(sums)
        order = np.lexsort(found.T[::-1])
        yield _phrases(lang, symbols, list(found[order].T), counts[order])


def _shards(count, bounds: Sequence[Phrase], bitmap, shard_words: int):
    """Texts in; one transducer per shard, language and range out."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent(bitmap.value) if bitmap is not None else None
        shard = _Shard()
        for batch in batches:
            for lang, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())):
                shard.add(lang.as_py(), text.as_py())
                if shard.size >= shard_words:
                    for counted in count(shard, frequent):
                        yield from _by_range(counted, bounds)
                    shard = _Shard()
        for counted in count(shard, frequent):
            yield from _by_range(counted, bounds)

    return shards


def _unions(least: int, held_counts: int):
    """Transducers sorted by range in; one per range out, without the phrases that are too rare."""

    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts = None, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            if held and len((kept := united(held, least)).counts):
                yield _packed(now, CountTransducer.of(kept))

        for batch in batches:
            for range_, transducer in _transducers(batch):
                if range_ != now:
                    yield from closed()
                    now, held, counts = range_, [], 0
                held.append(transducer)
                counts += len(transducer.weights)
                if counts >= held_counts and len(held) > 1:
                    held = [CountTransducer.of(united(held))]
                    # As much as is left has to come in before it is united again.
                    counts = min(0, held_counts - len(held[0].weights))
        yield from closed()

    return unions


def _counted(rows: DataFrame, count, bounds, bitmap, least: int, shard_words: int, held_counts: int) -> DataFrame:
    return written(
        rows.mapInArrow(_shards(count, bounds, bitmap, shard_words), SCHEMA)
        # By the range itself: hashes of few ranges would meet in some tasks and leave others without any.
        .repartitionById(partitions(rows.sparkSession), F.col("range")).sortWithinPartitions("range")
        .mapInArrow(_unions(least, held_counts), SCHEMA),
        "phrase-counts",
    )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, transducer in _transducers(batch):
            found = transducer.counted().items()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p, _ in found], pa.binary()).cast(pa.string()),
                 pa.array([b" ".join(p[1:]) for p, _ in found], pa.binary()).cast(pa.string()),
                 pa.array([len(p) - 1 for p, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())],
                names=["lang", "phrase", "size", "f"])


def listed(counted: DataFrame) -> DataFrame:
    """``lang, phrase, size, f``; of size 0 and empty the phrase that stands for all words."""
    return counted.mapInArrow(_listed, "lang string, phrase string, size int, f long")


def _bit_places(bits: int):
    """Transducers of words and pairs in, the bits that stand for these out."""

    def bit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, transducer in _transducers(batch):
                known: dict[Phrase, int] = {}
                words, pairs = [], []
                for (lang, *phrase), _ in transducer.counted().items():
                    for word in phrase:
                        if (lang, word) not in known:
                            known[lang, word] = int(_Frequent.hashes(lang, [word])[0])
                    if len(phrase) == 1:
                        words.append(known[lang, phrase[0]])
                    elif phrase:
                        pairs.append([known[lang, word] for word in phrase])
                one, other = np.array(pairs, np.uint64).reshape(-1, 2).T
                at = np.append(np.array(words, np.uint64), _Frequent.of_pair(one, other)) & np.uint64(bits - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    return bit_places


def _bitmap(counted: DataFrame, bits: int):
    """One bit per hash of a frequent word or pair, broadcast: ``bits / 8`` bytes, however many there are."""
    spark = counted.sparkSession
    width = min(bits, 1 << 15)
    found = (
        counted.mapInArrow(_bit_places(bits), "at long")
        .groupBy(F.expr(f"at div {width}").alias("part"))
        .agg(F.bitmap_construct_agg(F.col("at") % width).alias("bits")).collect()
    )
    out = bytearray(bits // 8)
    for row in found:
        start = row["part"] * width // 8
        out[start: start + width // 8] = row["bits"][: width // 8]
    return spark.sparkContext.broadcast(bytes(out))


def _some_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[Phrase] = []
        for lang, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())):
            words = [w for w in tokens(text.as_py()) if w not in (b"", b"\n")]
            for i in range(0, len(words), max(1, len(words) // PER_DOCUMENT)):
                found.append((lang.as_py(), *words[i: i + 2]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.list_(pa.binary())), pa.array([xxh64_intdigest(repr(x)) >> 1 for x in enumerate(found)], pa.int64())],
            names=["phrase", "hash"])


def _bounds(rows: DataFrame, ranges: int) -> list[Phrase]:
    """Where ranges of phrases begin, from a bounded sample; results do not depend on it."""
    some = rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(OF_DOCUMENTS)) == 0)
    found = some.mapInArrow(_some_phrases, "phrase array<binary>, hash long").orderBy("hash").limit(BOUND_SAMPLE)
    phrases = sorted(tuple(bytes(w) for w in row["phrase"]) for row in found.select("phrase").collect())
    return sorted({phrases[len(phrases) * i // ranges] for i in range(1, ranges)}) if phrases else []


def frequent_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
    shard_words: int = SHARD_WORDS, held_counts: int = HELD_COUNTS, filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, list[Phrase]]:
    """Count transducers by range of all phrases of 1 to ``LONGEST`` words with at least ``least``
    occurrences, and where the ranges begin. ``docs`` is read four times."""
    rows = docs.select(
        F.coalesce(column(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(column(text_col), F.lit("")).alias("text"),
    )
    bounds = _bounds(rows, partitions(docs.sparkSession))
    limits = (least, shard_words, held_counts)
    words = _counted(rows, _words, bounds, None, *limits)
    pairs = _counted(rows, _pairs, bounds, _bitmap(words, filter_bits), *limits)
    longer = _counted(rows, _longer, bounds, _bitmap(words.unionByName(pairs), filter_bits), *limits)
    return words.unionByName(pairs).unionByName(longer), bounds


# --- Collocations -----------------------------------------------------------------


def _in_ranges(bounds: Sequence[Phrase]):
    def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns))
            found = [bisect_right(bounds, (lang, *part.split(b" "))) for lang, part in keys]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.int32())], names=["lang", "part", "range"])

    return in_ranges


def _looked_up(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """The parts asked for in a range, composed with its counts."""
    keys = zip(*(asked[c].cast(pa.binary()).to_pylist() for c in ("lang", "part")))
    acceptor = CountTransducer.of(Counted.of(((lang, *part.split(b" ")), 0) for lang, part in keys))
    found = [x for _, transducer in _transducers(counted) for x in acceptor.composed(transducer)]
    return pa.table({
        "lang": pa.array([p[0] for p, _ in found], pa.binary()).cast(pa.string()),
        "part": pa.array([b" ".join(p[1:]) for p, _ in found], pa.binary()).cast(pa.string()),
        "f": pa.array([n for _, n in found], pa.int64()),
    })


def _sub_phrases(words: str, size: str) -> Column:
    return F.expr(f"flatten(transform(sequence(2, {size} - 1), m -> transform(sequence(1, {size} - m + 1), "
                  f"i -> array_join(slice({words}, i, m), ' '))))")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST, **limits,
) -> DataFrame:
    """The best ``most`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut with the lowest score
    ``floor(SCALE * a / (l + r))`` (the first of equal ones), ``n`` the language's words. A
    phrase inside a longer candidate that has at least 80 % of its occurrences is left out.
    A null text is empty, a null language ``und``; an empty table gives no rows.
    """
    counted, bounds = frequent_phrases(docs, lang_col, text_col, least, **limits)
    phrases = written(listed(counted), "frequent-phrases")
    all_ = phrases.where("size > 1").select("lang", "phrase", "size", "f", F.split("phrase", " ").alias("words"))
    inside = (
        all_.where("size > 2").select("lang", F.explode(_sub_phrases("words", "size")).alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    share, whole = INSIDE
    candidates = written(
        all_.join(inside, ["lang", "phrase"], "left")
        .where(F.expr(f"longer IS NULL OR CAST(longer AS decimal(20,0)) * {whole} < CAST(f AS decimal(20,0)) * {share}"))
        .select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr(
            "transform(sequence(1, size - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') AS first, "
            "array_join(slice(words, k + 1, size - k), ' ') AS rest))")).alias("cut"))
        .select("lang", "phrase", "a", "cut.*"),
        "collocation-cuts",
    )
    asked = candidates.select("lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    answers = written(
        asked.mapInArrow(_in_ranges(bounds), "lang string, part string, range int").groupBy("range")
        .cogroup(counted.groupBy("range")).applyInArrow(_looked_up, "lang string, part string, f long"),
        "part-counts",
    )
    part = lambda name, count: answers.select("lang", F.col("part").alias(name), F.col("f").alias(count))
    scored = (
        candidates.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
        .withColumn("score", F.expr(
            f"(CAST(a AS decimal(20,0)) * {SCALE}) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))"))
        .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    )
    best = first_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], most, rank="rank")
    totals = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
