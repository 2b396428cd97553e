"""Joins that hold for small and large sides alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of narrow rows has at most ``rows`` rows (counted, not guessed)."""
    return df.limit(rows + 1).count() <= rows


def join_hot(
    big: DataFrame, side: DataFrame, key: str, spread_by: str, how: str = "inner",
    small: bool | None = None, salts: int = SALTS,
) -> DataFrame:
    """Join a table with hot keys to a side table on ``key``.

    A side table of counted small size is broadcast, and the big table stays
    where it is. Otherwise both are shuffled on (key, salt): the big table is
    salted by ``spread_by``, the side table repeated once per salt, so a key
    that holds a third of all rows is spread over ``salts`` tasks.
    """
    if small is None:
        small = is_small(side)
    if small:
        return big.join(F.broadcast(side), key, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = side.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
