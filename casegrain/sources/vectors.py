"""Embedding tables: reuse saved vectors, find the ids still to encode."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cached_vectors(ids: DataFrame, cache: DataFrame, key: str = "doc_id") -> DataFrame:
    """Saved vectors of the current ids."""
    return cache.join(ids.select(key), key, "left_semi")


def ids_to_encode(ids: DataFrame, cache: DataFrame, key: str = "doc_id") -> DataFrame:
    """Current ids without a saved vector."""
    return ids.select(key).join(cache.select(key), key, "left_anti")
