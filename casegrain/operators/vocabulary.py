"""The most frequent one- and two-word terms, exactly, without shuffling all terms of a corpus.

Pass one: each task counts its terms, drops the rarest when it holds too many, and sends its
most frequent ones with a bound of what any term it does not send may have there. Their sums
give every term a lower and an upper count. Pass two counts exactly only the terms whose
upper count reaches the lower count of the last one that may be in.

Where nothing was dropped the first pass is exact already. Where the bounds exclude too few
terms, all of them are counted; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.operators.terms import (
    WORDS_AT_ONCE,
    coded,
    exploded,
    found_in_words,
    named,
    runs_of_rows,
    sorted_counts,
    with_term_counts,
)
from casegrain.workspace import written

#: Terms a task holds before it drops the rarer half, terms it sends per term wanted, candidates per term wanted.
HELD, SENT, CANDIDATES = 2_000_000, 4, 20
_COUNTS = "term string, freq long, df long"
_NAMES = ["term", "freq", "df", "spare"]


class _Counter:
    """Counts of one- and two-word terms as numbers: the first word's, then the second's plus one, 0 for none.

    What is new waits until it is as much as what is held, so that a term is not sorted again
    with every batch.
    """

    def __init__(self, held: int):
        self.held, self.words = held, pa.array([], pa.string())
        self.terms, self.freq, self.df = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.missed = 0

    def add(self, lists: pa.ListArray) -> None:
        for part in runs_of_rows(lists):
            rows, words, names = coded(part)
            if len(words):
                self._add(rows, words, names.cast(pa.string()), len(part))

    def _add(self, rows: np.ndarray, words: np.ndarray, names: pa.Array, n_rows: int) -> None:
        place = pc.index_in(names, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        place[new] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, names.take(pa.array(new))])
        width = len(names) + 1
        together = np.flatnonzero(rows[:-1] == rows[1:])
        terms = np.concatenate([words * width, words[together] * width + words[together + 1] + 1])
        cells, times = sorted_counts(terms * n_rows + np.concatenate([rows, rows[together]]))
        terms = cells // n_rows
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        first, second = np.divmod(terms[starts], width)
        second = np.where(second > 0, place[second - 1] + 1, 0)
        self.waiting.append((
            (place[first] << 32) | second, np.add.reduceat(times, starts), np.diff(np.append(starts, len(cells)))))
        if sum(len(w[0]) for w in self.waiting) > max(len(self.terms), min(self.held, WORDS_AT_ONCE)):
            self.merge()

    def merge(self) -> None:
        parts = [(self.terms, self.freq, self.df), *self.waiting]
        terms, freq, df = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.waiting = []
        if not len(terms):
            return
        order = np.argsort(terms)
        terms = terms[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        self.terms, self.freq, self.df = terms[starts], np.add.reduceat(freq[order], starts), np.add.reduceat(df[order], starts)
        if len(self.terms) > self.held:
            self.missed += self.cut(self.held // 2)

    def cut(self, most: int) -> int:
        """Keep the most frequent terms and their words; gives the largest count dropped."""
        if len(self.terms) <= most:
            return 0
        order = np.argsort(-self.freq, kind="stable")
        dropped = int(self.freq[order[most]])
        kept = np.sort(order[:most])
        self.freq, self.df = self.freq[kept], self.df[kept]
        first, second = self.terms[kept] >> 32, self.terms[kept] & 0xFFFFFFFF
        used = np.unique(np.concatenate([first, second[second > 0] - 1]))
        self.words = self.words.take(pa.array(used))
        second = np.where(second > 0, np.searchsorted(used, second - 1) + 1, 0)
        self.terms = (np.searchsorted(used, first) << 32) | second
        return dropped

    def named(self) -> pa.Array:
        return named(self.words, self.terms >> 32, (self.terms & 0xFFFFFFFF) - 1)


def _summaries(held: int, sent: int):
    """Per task its most frequent terms; a row with a null term says what it may have missed.

    ``spare`` is the part of that which does not concern the terms that were sent.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(held)
        for batch in batches:
            counter.add(batch.column(0))
        counter.merge()
        spare = counter.cut(sent)
        n = len(counter.terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.string()), *(pa.array([x], pa.int64()) for x in (0, 0, counter.missed + spare))], _NAMES)
        yield pa.RecordBatch.from_arrays(
            [counter.named(), pa.array(counter.freq), pa.array(counter.df), pa.array(np.full(n, spare, np.int64))], _NAMES)

    return summaries


def _exact(wanted):
    """Per task the counts of the wanted terms."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(wanted.value, pa.string())
        found, n = found_in_words(terms), len(terms)
        freq, df = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for _, _, place, tf in found(batch.column(0)):
                freq += np.bincount(place, tf, n).astype(np.int64)
                df += np.bincount(place, minlength=n)
        yield pa.RecordBatch.from_arrays([terms, pa.array(freq), pa.array(df)], _NAMES[:3]).filter(pa.array(df > 0))

    return exact


def _all_terms(words: DataFrame) -> DataFrame:
    counted = with_term_counts(words.select("words"), F.col("words"), pairs=True)
    return exploded(counted, [], "terms", "_t").groupBy(F.col("_t.term").alias("term")).agg(
        F.sum("_t.tf").alias("freq"), F.count(F.lit(1)).alias("df"))


def _first(counted: DataFrame, most: int, min_df: int) -> DataFrame:
    return counted.where(F.col("df") >= min_df).orderBy(F.col("freq").desc(), "term").limit(most)


def frequent_terms(
    words: DataFrame, most: int, min_df: int = 1, held: int = HELD, sent: int | None = None,
    candidates: int | None = None,
) -> DataFrame:
    """``term, freq, df`` of the ``most`` most frequent terms in at least ``min_df`` rows, ties by term.

    ``words`` has a column of that name, the words of each row, and should be a written table,
    since it is read twice. At most ``candidates`` terms travel to the tasks.
    """
    sent, candidates = sent or SENT * most, candidates or CANDIDATES * most
    rows = words.select(F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    parts = written(
        rows.mapInArrow(_summaries(held, sent), f"{_COUNTS}, spare long"), "term-summaries")
    missed = parts.where("term IS NULL").agg(F.coalesce(F.sum("spare"), F.lit(0))).first()[0]
    lower = parts.where("term IS NOT NULL").groupBy("term").agg(
        F.sum("freq").alias("freq"), F.sum("df").alias("df"), F.sum("spare").alias("spare"))
    if missed == 0:
        return _first(lower, most, min_df)
    lower = written(lower, "term-bounds")
    sure = _first(lower, most, min_df).agg(F.count(F.lit(1)).alias("n"), F.min("freq").alias("least")).first()
    if sure["n"] < most or sure["least"] <= missed:
        return _first(_all_terms(rows), most, min_df)
    possible = lower.where(F.col("freq") + missed - F.col("spare") >= sure["least"]).select("term")
    found = possible.limit(candidates + 1).collect()
    if len(found) > candidates:
        return _first(_all_terms(rows), most, min_df)
    wanted = words.sparkSession.sparkContext.broadcast([r["term"] for r in found])
    exact = rows.mapInArrow(_exact(wanted), _COUNTS).groupBy("term").agg(
        F.sum("freq").alias("freq"), F.sum("df").alias("df"))
    return _first(exact, most, min_df)
