"""Autocomplete over a table of queries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from vellum.constants import SUGGEST_LIMIT, SUGGEST_MAX_LIMIT
from vellum.operators.suggestions import (
    live_suggestions, prepare_queries, scored_values, top_suggestions, value_grams, value_pool,
)
from vellum.session import spread, stage_table


class Index(NamedTuple):
    """Rows that can reach a pool of `limit`, and distinct values with trigrams."""

    pool: DataFrame
    grams: DataFrame
    limit: int


def build_index(suggestions: DataFrame, books: DataFrame, limit: int = SUGGEST_MAX_LIMIT) -> Index:
    """Both tables written once; good for any limit up to the one given."""
    pool = stage_table(value_pool(live_suggestions(suggestions, books), limit))
    return Index(pool, stage_table(spread(value_grams(pool))), limit)


def suggest(
    queries: DataFrame, suggestions: DataFrame, books: DataFrame, limit: int = SUGGEST_LIMIT, escape: bool = False, index: Index | None = None,
) -> DataFrame:
    """Up to `limit` suggestions per query: (query_id, position, book_id, kind, value, score)."""
    index = index or build_index(suggestions, books, limit)
    if limit > index.limit:
        raise ValueError(f"the index was cut for at most {index.limit} suggestions")
    scored = scored_values(prepare_queries(queries, escape), index.grams, escape)
    return top_suggestions(scored, index.pool, limit).select(
        "query_id", "position", "book_id", "kind", "value", "normalized_value", "score"
    )
