"""Term counting inside the row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose counts a task makes at once; a longer row is taken alone.
WORDS_AT_ONCE = 1 << 19


def runs_of_rows(lists: pa.ListArray, most: int = WORDS_AT_ONCE) -> Iterator[pa.ListArray]:
    """A batch in pieces with at most ``most`` words, or of one row."""
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(lists):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lists.slice(start, stop - start)
        start = stop


def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each word, and the distinct words, in byte order, that the codes count through."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    found = lists.flatten().dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    rows = np.repeat(np.arange(len(lists), dtype=np.int64), sizes)
    return rows, place[found.indices.to_numpy()], found.dictionary.take(order)


def sorted_counts(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and how often each occurs."""
    ordered = np.sort(numbers)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def named(words: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Terms by the codes of their words; a one-word term has -1 as its second."""
    one = words.take(pa.array(first))
    if not (second >= 0).any():
        return one
    two = pc.binary_join_element_wise(one, words.take(pa.array(np.maximum(second, 0))), " ")
    return pc.if_else(pa.array(second >= 0), two, one)


def _counts_of_rows(lists: pa.ListArray, pairs: bool) -> pa.ListArray:
    rows, words, names = coded(lists)
    width = len(names) + 1  # the second word's code plus one, 0 for none
    numbers = (rows * width + words) * width
    if pairs and len(words):
        together = np.flatnonzero(rows[:-1] == rows[1:])
        numbers = np.concatenate([numbers, numbers[together] + words[together + 1] + 1])
    numbers, tf = sorted_counts(numbers)
    row, word = np.divmod(numbers // width, width)
    terms = named(names, word, numbers % width - 1).cast(pa.string())
    entries = pa.StructArray.from_arrays([terms, pa.array(tf.astype(np.int32))], names=["term", "tf"])
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lists)))])
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), entries)


def _counting(pairs: bool):
    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_counts_of_rows(part, pairs) for part in runs_of_rows(batch)]
            yield pa.concat_arrays(parts) if parts else _counts_of_rows(batch, pairs)

    return counted


def with_term_counts(df: DataFrame, terms: Column, out: str = "terms", pairs: bool = False) -> DataFrame:
    """Add ``out: array<struct<term, tf>>``, the distinct terms of each row in byte order.

    A document lies whole in one row, so its terms are counted there and no
    shuffle is needed: words become numbers, and sorted numbers are counted.
    With ``pairs`` the adjacent pairs of ``terms`` are terms too; they are
    strings only where they are distinct.
    """
    return df.withColumn(out, _counting(pairs)(terms))


def found_in_words(known: pa.Array):
    """Finds the known one- and two-word terms of a batch of words, by the numbers of their words.

    Gives pieces of the batch, each with row, place among the known terms and count, by row and place.
    """
    split = [term.split(" ", 1) for term in known.to_pylist()]
    names = sorted({word for words in split for word in words})
    number = {word: i for i, word in enumerate(names)}
    width = len(names) + 1
    numbers = np.array([number[w[0]] * width + (number[w[1]] + 1 if len(w) > 1 else 0) for w in split], np.int64)
    order = np.argsort(numbers)
    numbers, names = numbers[order], pa.array(names, pa.string())

    def found(batch: pa.ListArray) -> Iterator[tuple[pa.ListArray, np.ndarray, np.ndarray, np.ndarray]]:
        for part in runs_of_rows(batch):
            row, words, distinct = coded(part)
            place = pc.index_in(distinct.cast(pa.string()), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
            words = place.astype(np.int64)[words]
            pair = np.flatnonzero((row[:-1] == row[1:]) & (words[:-1] >= 0) & (words[1:] >= 0))
            one = np.flatnonzero(words >= 0)
            terms = np.concatenate([words[one] * width, words[pair] * width + words[pair + 1] + 1])
            row = np.concatenate([row[one], row[pair]])
            at = np.searchsorted(numbers, terms)
            hit = np.flatnonzero(numbers[np.minimum(at, len(numbers) - 1)] == terms) if len(numbers) else at[:0]
            cells, tf = sorted_counts(row[hit] * len(numbers) + order[at[hit]])
            row, idx = np.divmod(cells, max(len(numbers), 1))
            yield part, row, idx.astype(np.int32), tf

    return found


def exploded(df: DataFrame, keep: list, array: Column | str, out: str) -> DataFrame:
    """``keep`` columns and one row per array element.

    Spark guards a plain ``explode`` with a filter on the array's size and
    pushes that filter down to where the array is computed, so that costly
    arrays are computed twice. The outer form has no such filter; its one null
    row for an empty array is dropped afterwards.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(out))
    return rows.where(F.col(out).isNotNull())


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    A plain projection would be copied into every filter above it, and those
    filters pushed down to the scan. What a generator gives is not copied.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))
