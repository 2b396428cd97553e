"""Spelling variants: words one edit apart, by a bit-sliced position index.

Two words that differ by one inserted, deleted or replaced letter agree in the first or in
the second half of the longer one. Words are dealt out by these halves, and what is left
of them is compared inside each group. There the vocabulary is one bitset per (position,
letter): bit i says that word i has the letter there. A word is looked up by reading it
once; with each letter the sets of words that agree so far with no error, and with one
replaced, missing or extra letter, move on together, all words in parallel. Bits are
ordered by falling frequency, so the lowest one of a set is the most frequent word.

A crowded group is cut into pieces; each of its words is then looked up in each piece.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm.shared import partitions, plain
from casegrain.workspace import written

LEAST_LETTERS, LEAST_COUNT = 5, 3
ERASED = 97
AT_LEAST = 2
PIECE = 4096
KNOWN_WORDS = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: bytes, erased: int | None = ERASED) -> Counter:
    """Words of a text and how often each occurs: runs of Latin-1 letters, A-Z lower-cased.

    Where ``erased`` divides the crc32 of ``<doc_id>:<run>`` one letter goes, as if mistyped;
    a null id stands for the empty text there.
    """
    runs = Counter(_RUN.findall(text.lower().decode()))
    if erased is None:
        return runs
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = crc32(run.encode(), start)
        if h % erased == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def _counted(erased: int | None, letters: int):
    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for word, n in words_of(doc_id, text.as_py(), erased).items():
                    if len(word) >= letters:
                        counts[word] += n
                if len(counts) >= KNOWN_WORDS:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    return counted


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS,
    least: int = LEAST_COUNT, erased: int | None = None,
) -> DataFrame:
    """``word, n`` of the words of enough letters and occurrences; a task's own are counted together first."""
    parts = plain(docs, id_col, text_col).mapInArrow(_counted(erased, letters), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """Bitsets by (position, letter) over what is left of a group's words beside their common half.

    The words are of two lengths: ``longer`` ones and those one letter shorter. They come in
    falling order of preference, so that the lowest bit of a result is the best word.
    """

    def __init__(self, rests: Sequence[str], longer: Sequence[bool]):
        self.at: dict[tuple[int, str], int] = {}
        self.longer = self.shorter = 0
        for number, (rest, is_longer) in enumerate(zip(rests, longer)):
            bit = 1 << number
            for place in enumerate(rest):
                self.at[place] = self.at.get(place, 0) | bit
            if is_longer:
                self.longer |= bit
            else:
                self.shorter |= bit

    def of_longer(self, rest: str, common: str | None = None) -> int:
        """Words one edit from a longer one.

        ``common`` is the first letter of a common second half: there a shorter word that
        shares the first half too is left out, since that half's group has it.
        """
        exact = self.longer | self.shorter
        replaced = missing = before = 0
        for i, letter in enumerate(rest):
            same = self.at.get((i, letter), 0)
            missing = (missing & self.at.get((i - 1, letter), 0)) | exact
            replaced = (replaced & same) | (exact & ~same)
            before, exact = exact, exact & same
        if common is not None and rest[-1] == common:
            missing &= ~before
        return (replaced & self.longer) | (missing & self.shorter)

    def of_shorter(self, rest: str, common: str | None = None) -> int:
        """Longer words that have one letter more than a shorter one; ``common`` as above."""
        exact = self.longer
        extra = 0
        for i, letter in enumerate(rest):
            extra = (extra | exact) & self.at.get((i + 1, letter), 0)
            exact &= self.at.get((i, letter), 0)
        found = extra | exact
        if common is not None:
            found &= ~(exact & self.at.get((len(rest), common), 0))
        return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by group and piece, indexed ones first in order of preference; near words of each row out."""
    key, held, index, out = None, [], None, []

    def looked_up(rows) -> Iterator[tuple[str, int, int, str]]:
        for word, n, rest, longer, common in rows:
            found = (index.of_longer if longer else index.of_shorter)(rest, common)
            if found:
                best = held[(found & -found).bit_length() - 1]
                yield word, found.bit_count(), best[1], best[0]

    def closed() -> Iterator[tuple[str, int, int, str]]:
        nonlocal index
        if len(held) > 1:
            index = PositionIndex([r[2] for r in held], [r[3] for r in held])
            yield from looked_up(held)

    def packed(rows) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ((), (), (), ())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "near", "best_n", "best"])

    for batch in batches:
        names = ("key", "piece", "indexed", "word", "n", "rest", "longer", "common")
        for k, piece, indexed, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if (k, piece) != key:
                if index is None:
                    out.extend(closed())
                key, held, index = (k, piece), [], None
            if indexed:
                held.append(row)
                continue
            if index is None:  # the piece is complete; its own words are looked up as well
                index = PositionIndex([r[2] for r in held], [r[3] for r in held])
                out.extend(looked_up(held))
            out.extend(looked_up([row]))
        if out:
            yield packed(out)
            out = []
    if index is None:
        out.extend(closed())
    yield packed(out)


def _halves(words: DataFrame) -> DataFrame:
    """Each word by the halves it may share: with words of its length or shorter, and with longer ones."""
    sides = []
    for shorter in (0, 1):
        long = f"(char_length(word) + {shorter})"
        half = f"({long} div 2)"
        first, second = f"left(word, {half})", f"right(word, {long} - {half})"
        sides += [
            f"struct(concat({long}, '<', {first}) AS key, substr(word, {half} + 1) AS rest, "
            f"{shorter} = 0 AS longer, CAST(NULL AS STRING) AS common)",
            f"struct(concat({long}, '>', {second}) AS key, left(word, {half} - {shorter}) AS rest, "
            f"{shorter} = 0 AS longer, left({second}, 1) AS common)",
        ]
    return words.select("word", "n", F.expr(f"explode(array({', '.join(sides)}))").alias("side")).select(
        "word", "n", "side.*")


def near_words(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """``word, n_near, best_n, best`` for each of the distinct ``word, n`` that has a near word.

    ``best`` is the near word of largest ``n``, of equal ones the smallest in code-point order.
    No pairs leave a task: a group gives one row per word.
    """
    spark = words.sparkSession
    halves = _halves(words)
    crowded = written(
        halves.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > piece)
        .select("key", F.ceil(F.col("members") / piece).cast("int").alias("pieces")),
        "crowded-halves",
    )
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    dealt = (
        halves.join(crowded, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("indexed", F.col("piece") == own)
        .select("key", "piece", "indexed", "word", "n", "rest", "longer", "common")
    )
    found = (
        dealt.repartition(partitions(spark), "key", "piece")
        .sortWithinPartitions("key", "piece", F.desc("indexed"), F.desc("n"), "word")
        .mapInArrow(_near, "word string, near long, best_n long, best string")
    )
    first = F.min(F.struct((-F.col("best_n")).alias("order"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", (-F.col("first.order")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the end of the chain of forms, by doubling its steps.

    A form is at least ``AT_LEAST`` times as frequent, so chains are short and have no cycles.
    """
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while now.where("moved").limit(1).count():
        then = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = written(
            now.join(then, "root", "left")
            .select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")),
            "roots",
        )
    return now.select("word", "root")


def variant_groups(words: DataFrame, at_least: int = AT_LEAST, piece: int = PIECE) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` for each of the distinct ``word, n``.

    A word's form is its near word of largest ``n`` if that is ``at_least`` times its own; the
    root is where the forms end. A word without near words keeps null, itself and 0; an empty
    table gives no rows.
    """
    words = written(words, "vocabulary")
    near = written(near_words(words, piece), "near-words")
    known = words.join(near, "word", "left").withColumn("is_form", F.col("best_n") >= at_least * F.col("n"))
    known = written(
        known.select("word", "n", F.when(F.col("is_form"), F.col("best")).alias("form"),
                     F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(F.col("is_form"), F.col("best_n")).alias("form_n")),
        "word-forms",
    )
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
