"""Is one result better than another: McNemar's test and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain import fixed_values as fixed

#: Below so many rows on which two models differ the binomial tail is summed exactly.
EXACT_BELOW = 25
REPLICATES = 200
#: Replicate weights come from hashes modulo this prime.
PRIME = 2**31 - 1
GROUPS_HELD = 1000


# --- Paired predictions -------------------------------------------------------------


def p_value(only_first: int, only_second: int) -> float:
    """Two-sided."""
    n = only_first + only_second
    if n == 0:
        return 1.0
    if n < EXACT_BELOW:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(only_first, only_second) + 1)) / 2**n)
    return math.erfc(math.sqrt(max(abs(only_first - only_second) - 1, 0) ** 2 / n / 2))


def mcnemar(
    predictions: DataFrame, truth: str, first: str, second: str, keys: Sequence[str] = (),
) -> DataFrame:
    """McNemar's test of two prediction columns on the same rows.

    ``keys``, the four counts ``both_right, only_first, only_second, none_right``, the ``statistic`` with
    continuity correction (null if the models are right on the same rows) and the ``p_value``,
    exact where fewer than ``EXACT_BELOW`` rows tell them apart. A null prediction is wrong, rows
    without a truth are left out.
    """
    right = lambda c: F.coalesce(F.col(c) == F.col(truth), F.lit(False))
    one, other = right(first), right(second)
    counts = predictions.where(F.col(truth).isNotNull()).groupBy(*keys).agg(*[
        F.count_if(when).alias(name) for name, when in (
            ("both_right", one & other), ("only_first", one & ~other),
            ("only_second", ~one & other), ("none_right", ~one & ~other))
    ])
    apart = F.col("only_first") + F.col("only_second")
    gap = F.greatest(F.abs(F.col("only_first") - F.col("only_second")) - 1, F.lit(0)).cast("double")

    @F.arrow_udf("double")  # on contingency counts, a row per key
    def p_values(first: pa.Array, second: pa.Array) -> pa.Array:
        return pa.array(map(p_value, first.to_pylist(), second.to_pylist()), pa.float64())

    return counts.withColumn("statistic", F.when(apart > 0, gap * gap / apart)).withColumn(
        "p_value", p_values("only_first", "only_second"))


# --- Bootstrap ----------------------------------------------------------------------


def replicate_factors(replicates: int, seed: int = fixed.SEED) -> list[tuple[int, int]]:
    """Per replicate the factor and the addend of its hash, from a Lehmer generator."""
    x, out = seed, []
    for _ in range(replicates):
        pair = []
        for _ in range(2):
            x = 48271 * x % PRIME
            pair.append(x)
        out.append(tuple(pair))
    return out


def poisson_bounds(most: int = 12) -> list[int]:
    """A hash reaches so many of these bounds as the Poisson(1) weight says."""
    below, term, out = 0.0, math.exp(-1), []
    for k in range(most):
        below += term
        out.append(int(below * PRIME))
        term /= k + 1
    return out


def row_hash(id_column: str, seed: int = fixed.SEED) -> Column:
    """28 bits of a row's own hash, the same in any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def _weighted(replicates: int, seed: int):
    factors = np.array(replicate_factors(replicates, seed), np.int64)
    bounds = np.array(poisson_bounds(), np.int64)
    names = ["group", "replicate", "weight", "total"]

    def packed(sums: dict) -> pa.RecordBatch:
        """Replicate -1 has every row once."""
        groups = [g for g in sums for _ in range(replicates + 1)]
        numbers = list(range(-1, replicates)) * len(sums)
        weights, totals = (np.concatenate([np.zeros(0), *(s[i] for s in sums.values())]) for i in (0, 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(groups, pa.string()), pa.array(numbers, pa.int32()), pa.array(weights.astype(np.int64)),
             pa.array(totals)], names=names)

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            code = np.asarray(coded.indices)
            hashes, values = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for i, group in enumerate(coded.dictionary.to_pylist()):
                h, x = hashes[code == i], values[code == i]
                w = np.searchsorted(bounds, (h[:, None] * factors[:, 0] + factors[:, 1]) % PRIME, side="right")
                weight, total = np.concatenate([[len(h)], w.sum(axis=0)]), np.concatenate([[x.sum()], x @ w])
                old = sums.get(group, (0, 0))
                sums[group] = old[0] + weight, old[1] + total
            if len(sums) >= GROUPS_HELD:
                yield packed(sums)
                sums = {}
        yield packed(sums)

    return weighted


def bootstrap_means(
    rows: DataFrame, id_column: str, value: str, group: str, replicates: int = REPLICATES,
    level: float = 0.95, seed: int = fixed.SEED,
) -> DataFrame:
    """``group, n, mean, low, high``: the mean of ``value`` with its percentile bootstrap interval.

    Poisson bootstrap in one pass: each row counts in each replicate with a Poisson(1) weight
    that its id's hash gives, and tasks send one sum per group and replicate. No row is copied
    or shuffled, and the intervals do not depend on the partitioning. Rows without a value are
    left out; a null group is a group.
    """
    given = rows.where(F.col(value).isNotNull()).select(
        F.col(group).cast("string").alias("group"), row_hash(id_column, seed).alias("hash"),
        F.col(value).cast("double").alias("value"))
    sums = given.mapInArrow(
        _weighted(replicates, seed), "group string, replicate int, weight long, total double",
    ).groupBy("group", "replicate").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    mean = F.col("total") / F.col("weight")
    whole, drawn = F.col("replicate") < 0, (F.col("replicate") >= 0) & (F.col("weight") > 0)
    edge = lambda p: F.percentile(F.when(drawn, mean), p)
    return sums.groupBy("group").agg(
        F.max(F.when(whole, F.col("weight"))).alias("n"), F.max(F.when(whole, mean)).alias("mean"),
        edge((1 - level) / 2).alias("low"), edge((1 + level) / 2).alias("high"),
    ).withColumnRenamed("group", group)
