"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.workspace import written


def _star(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (src, dst) and, written apart, the smallest of each src and its dst."""
    lowest = pairs.groupBy("src").agg(F.min("dst").alias("low")).select(
        "src", F.least("src", "low").alias("low")
    )
    return pairs, written(lowest, name)


def _step(edges: DataFrame) -> DataFrame:
    """Large star, then small star; a hub's many edges meet one row of minima, which Spark can split."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs, lowest = _star(both, "star")
    large = written(
        pairs.join(lowest, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .distinct(),
        "large-star",
    )
    pairs, lowest = _star(large, "star")
    moved = pairs.join(lowest, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    roots = lowest.select("src", F.col("low").alias("dst"))
    return written(moved.unionByName(roots).where("src <> dst").distinct(), "small-star")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node with an edge; the component is its smallest node.

    ``edges`` has ``src`` and ``dst`` of one ordered type. Edges with a null end and loops
    are left out; no edges give no rows. Every step is written, so lineage stays short.
    """
    now = written(
        edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .distinct(),
        "edges",
    )
    state = None
    while True:
        summed = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
        if tuple(summed) == state or summed["n"] == 0:
            break
        state = tuple(summed)
        now = _step(now)
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
