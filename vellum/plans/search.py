"""Hybrid search and reranked search over a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.constants import (
    CACHE_TTL_SECONDS, CACHE_WINDOW, PAGE_LIMIT, RERANK_REQUEST_CANDIDATES,
)
from vellum.functions.scoring import group_size, grouped_limit, prefetch_limit, prefetch_size
from vellum.operators import ranking
from vellum.operators.merges import keep_first
from vellum.operators.postings import corpus_size, point_terms
from vellum.operators.retrieval import (
    BROADCAST_HITS, dense_top_k, fuse, group_by_book, query_term_table, sparse_top_k, valid_hits,
)
from vellum.session import has_at_most, stage_table, union_all
from vellum.sources import snapshots as snap

PAYLOAD = [
    "point_id", "book_id", "chapter_id", "chapter_index", "chapter_title", "chunk_index", "text",
    "source_start_char", "source_end_char", "cover_s3_file_path",
]


def point_postings(points: DataFrame, compatibility: bool = True) -> DataFrame:
    """Sparse index of a point table, a row per point; write it once where many searches follow."""
    return point_terms(points, keep=["is_searchable"], compatibility=compatibility)


def grouped_hits(
    queries: DataFrame, points: DataFrame, postings: DataFrame | None, groups: int, prefetch: int, compatibility: bool = True,
) -> DataFrame:
    """Fused hits of both branches, grouped by book, with payload.

    With `_prefetch` and `_groups` columns on the queries the limits differ
    per query and the two numbers are their upper bounds.
    """
    searchable = points.filter("is_searchable")
    vectors = searchable.select("point_id", F.col("dense").alias("vector"))
    dense = dense_top_k(queries, vectors, prefetch)
    asked = query_term_table(queries, compatibility)
    if postings is None:
        postings = point_postings(points, compatibility)
    sparse = sparse_top_k(asked, postings, corpus_size(points), prefetch)
    if "_prefetch" in queries.columns:
        own = queries.select("query_id", "_prefetch")
        dense, sparse = (
            b.join(own, "query_id").filter(F.col("rank0") < F.col("_prefetch")).drop("_prefetch") for b in (dense, sparse)
        )
    payload = points.select(*PAYLOAD)
    fused = fuse([dense, sparse])
    # at most two lists of `prefetch` hits per query
    small = has_at_most(queries, BROADCAST_HITS // (2 * prefetch))
    return group_by_book(payload.join(F.broadcast(fused) if small else fused, "point_id"), groups)


def hybrid_search(
    queries: DataFrame, points: DataFrame, postings: DataFrame | None = None, offset: int = 0, limit: int = PAGE_LIMIT,
    compatibility: bool = True,
) -> DataFrame:
    """One page of books per query in fused order.

    `queries(query_id, query, vector)`; with an `offset` column each query has
    its own page and `offset` is the largest one. Gives `position` from 0,
    the representative hit, `total` books found and `next_offset`.
    """
    asked = queries
    if "offset" in queries.columns:
        asked = queries.withColumns(
            {
                "_groups": group_size(F.col("offset"), limit),
                "_prefetch": prefetch_size(F.col("offset"), limit),
            }
        )
    groups, prefetch = grouped_limit(offset, limit), prefetch_limit(offset, limit)
    hits = grouped_hits(asked, points, postings, groups, prefetch, compatibility)
    start = F.col("offset") if "offset" in queries.columns else F.lit(offset)
    features = ranking.query_features(queries.select("query_id", "query", start.alias("offset")), compatibility)
    valid = valid_hits(hits.join(features, "query_id"))
    if "_groups" in asked.columns:
        valid = valid.filter(F.col("book_rank") <= F.col("offset") + limit + 1)
    items = ranking.representative_hits(ranking.with_policy_inputs(valid, compatibility))
    # groups without a valid hit are gone before the page is cut
    order = ranking.Window.partitionBy("query_id").orderBy("book_rank")
    every = ranking.Window.partitionBy("query_id")
    placed = items.withColumns(
        {"position": F.row_number().over(order) - 1, "_found": F.count(F.lit(1)).over(every)}
    )
    more = F.col("_found") > F.col("offset") + limit
    shown = F.least(F.col("_found") - F.col("offset"), F.lit(limit))
    return placed.filter((F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + limit)).withColumns(
        {"more_after": more, "next_offset": F.when(more, (F.col("offset") + shown).cast("int"))}
    ).drop("_found", "hit_rank", "book_rank")


def with_read_model(hits: DataFrame, read_model: DataFrame) -> DataFrame:
    """Hits of books that the read model knows, with its columns; ids are compared as text."""
    books = read_model.withColumn("book_id", F.col("book_id").cast("string"))
    return hits.withColumn("book_id", F.col("book_id").cast("string")).join(books, "book_id")


def resolve_window(configured: int = CACHE_WINDOW, max_candidates: int = RERANK_REQUEST_CANDIDATES) -> int:
    return min(configured, max_candidates)


def search(
    requests: DataFrame, points: DataFrame, read_model: DataFrame, now: Column, postings: DataFrame | None = None,
    snapshots: DataFrame | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None,
    window: int | None = None, ttl_seconds: int = CACHE_TTL_SECONDS, compatibility: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Result pages of `requests(query_id, query, vector, offset)`, and new snapshots.

    Inside the window a query's books are reranked once, ordered by the
    policy, and pages are cut from that list; beyond it pages come from the
    fused order. Rows of a page are finally ordered by rerank score.
    """
    window = resolve_window() if window is None else window
    reranker = reranker or (lambda items: ranking.rerank_by_overlap(items, compatibility))
    keyed = snap.with_key(requests, window, compatibility)
    near = keyed.filter(F.col("offset") < window)

    pieces = []
    misses = near
    if snapshots is not None:
        hits, misses = snap.split_by_snapshot(near, snapshots, now, ttl_seconds)
        cached = hits.select("cache_key", "items", F.col("has_more_after_window").alias("more_after")).dropDuplicates(["cache_key"])
        pieces.append(
            cached.select("cache_key", "more_after", F.size("items").alias("total"), F.posexplode("items").alias("position", "_i"))
            .select("cache_key", "position", F.col("_i.book_id").alias("book_id"), F.col("_i.score").alias("score"),
                    F.col("_i.rerank_score").alias("rerank_score"), "total", "more_after")
        )
    unique = keep_first(misses.select("cache_key", "query_id", "query", "vector"), ["cache_key"], [F.col("query_id")])
    found = hybrid_search(unique.select("query_id", "query", "vector"), points, postings, 0, window, compatibility)
    reranked = reranker(found.drop("position"))
    # pages and snapshots both read it, so the search runs once; at most `window` rows per query
    ranked = stage_table(ranking.rank_books(reranked).join(unique.select("query_id", "cache_key"), "query_id"))
    fresh = snap.snapshot_rows(ranked, now)
    total = F.count(F.lit(1)).over(ranking.Window.partitionBy("cache_key")).cast("int")
    pieces.append(
        ranked.withColumn("total", total).select(
            "cache_key", "position", F.col("book_id").cast("string").alias("book_id"), "score", "rerank_score", "total", "more_after"
        )
    )
    listed = pieces[0]
    for piece in pieces[1:]:
        listed = union_all(listed, piece)
    wanted = near.select("query_id", "cache_key", "offset")
    pages = ranking.page_of(wanted.join(listed, "cache_key"), F.col("offset")).select(
        "query_id", "offset", "book_id", "score", "rerank_score", "next_offset"
    )

    deep = keyed.filter(F.col("offset") >= window)
    # one number about the request table decides the size of the deep branch
    farthest = deep.agg(F.max("offset")).first()[0]
    if farthest is not None:
        beyond = hybrid_search(deep.select("query_id", "query", "vector", "offset"), points, postings, farthest, PAGE_LIMIT, compatibility)
        pages = union_all(pages, beyond.select("query_id", "offset", F.col("book_id").cast("string").alias("book_id"), "score",
                          F.lit(None).cast("double").alias("rerank_score"), "next_offset"))
    return with_read_model(ranking.final_order(pages), read_model), fresh
