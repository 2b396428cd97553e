"""Importing this module registers every query."""

from casegrain.plans import (  # noqa: F401
    corpus_queries,
    learning_queries,
    retrieval_queries,
    source_queries,
    statistics_queries,
    text_queries,
)
from casegrain.plans.catalog import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
