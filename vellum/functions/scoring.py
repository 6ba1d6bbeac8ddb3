"""BM25, rank fusion and the ranking policy as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.constants import (
    BM25_AVG_LEN, BM25_B, BM25_K1, MIN_PREFETCH, PREFETCH_PER_GROUP, RERANK_CANDIDATE_CHARS,
    RERANK_QUERY_CHARS, RRF_K,
)
from vellum.functions.text import let, strip


def bm25_weight(tf: Column, doc_len: Column, k1: float = BM25_K1, b: float = BM25_B, avg_len=BM25_AVG_LEN) -> Column:
    tf = tf.cast("double")
    ratio = doc_len.cast("double") / F.lit(avg_len) if not isinstance(avg_len, Column) else doc_len / avg_len
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))


def idf(points: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (points - df + 0.5) / (df + 0.5))


def rrf(rank0: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (rank0 + k)


def grouped_limit(offset: int, limit: int) -> int:
    return offset + limit + 1


def group_size(offset: Column, limit: int) -> Column:
    """grouped_limit() of every row."""
    return (offset + limit + 1).cast("int")


def prefetch_size(offset: Column, limit: int) -> Column:
    """prefetch_limit() of every row."""
    return F.greatest(F.lit(MIN_PREFETCH), group_size(offset, limit) * PREFETCH_PER_GROUP)


def prefetch_limit(offset: int, limit: int) -> int:
    return max(MIN_PREFETCH, grouped_limit(offset, limit) * PREFETCH_PER_GROUP)


def term_overlap(terms: Column, hay: Column) -> Column:
    """How many terms occur as substrings of the normalised text."""
    return let(hay, lambda h: F.size(F.filter(terms, lambda t: F.contains(h, t))))


def representative_score(score: Column, overlap: Column, demote: Column, front_matter: Column) -> Column:
    penalty = F.when(demote & (overlap == 0) & front_matter, 1.5).otherwise(0.0)
    return score + overlap * 2 + F.when(overlap > 0, 1).otherwise(0) - penalty


def ranked_book_score(
    score: Column, rerank_score: Column, overlap: Column, demote: Column, front_matter: Column
) -> Column:
    boost = F.when(overlap > 0, 1 + overlap * 0.35).otherwise(0.0)
    penalty = F.when(demote & (overlap == 0) & front_matter, 0.8).otherwise(0.0)
    return F.coalesce(rerank_score, score) + boost - penalty + score * 0.05


def rerank_query(query: Column) -> Column:
    return F.substring(strip(query), 1, RERANK_QUERY_CHARS)


def rerank_text(title: Column, text: Column) -> Column:
    """Title and text of a candidate, cut the way the scorer cuts its input."""
    def part(c: Column) -> Column:
        trimmed = strip(c)
        return F.when(F.length(trimmed) > 0, trimmed)

    joined = F.concat_ws("\n\n", part(title), part(text))
    return F.substring(strip(joined), 1, RERANK_CANDIDATE_CHARS)


def overlap_score(query_tokens: Column, text_tokens: Column) -> Column:
    """Stand-in for a cross-encoder: share of the query's tokens in the text."""
    asked = F.array_distinct(query_tokens)
    shared = F.size(F.array_intersect(asked, text_tokens)).cast("double")
    return F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(F.lit(0.0))
