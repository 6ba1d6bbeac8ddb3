"""Representative hits, reranking with fallback, policy order and pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.constants import PAGE_LIMIT, RERANK_BATCH, RERANK_MAX_CANDIDATES, RERANK_TIMEOUT_SECONDS, RERANK_TOP_K, SCORE_DIGITS
from vellum.functions import scoring
from vellum.functions.text import (
    demotes_front_matter, normalize_search_text, opens_front_matter, query_terms, tokenize,
)
from vellum.operators.merges import keep_first

Scorer = Callable[[list[tuple[str, str]]], list[float]]


def query_features(queries: DataFrame, compatibility: bool = True) -> DataFrame:
    """Adds `terms` and `demote` to a table with a `query` column."""
    tokens = tokenize(F.col("query"), compatibility)
    return (
        queries.withColumn("_tokens", tokens)
        .withColumn("terms", query_terms(F.col("_tokens")))
        .withColumn("demote", demotes_front_matter(F.col("_tokens"), F.col("terms")))
        .drop("_tokens")
    )


def with_policy_inputs(hits: DataFrame, compatibility: bool = True) -> DataFrame:
    """Adds `overlap` and `front_matter`; needs terms, chapter_title, text, source_start_char."""
    normal = hits.withColumns(
        {
            "_title": normalize_search_text(F.col("chapter_title"), compatibility),
            "_body": normalize_search_text(F.col("text"), compatibility),
        }
    )
    return normal.withColumns(
        {
            "overlap": scoring.term_overlap(F.col("terms"), F.concat_ws("\n", "_title", "_body")),
            "front_matter": opens_front_matter(F.col("_title"), F.col("_body"), F.col("source_start_char")),
        }
    ).drop("_title", "_body")


def representative_hits(hits: DataFrame) -> DataFrame:
    """One hit per (query, book): best policy score, then best fused rank."""
    scored = hits.withColumn(
        "_policy",
        F.round(
            scoring.representative_score(F.col("score"), F.col("overlap"), F.col("demote"), F.col("front_matter")),
            SCORE_DIGITS,
        ),
    )
    return keep_first(scored, ["query_id", "book_id"], [-F.col("_policy"), F.col("hit_rank")]).drop("_policy")


def rerank_by_overlap(items: DataFrame, compatibility: bool = True) -> DataFrame:
    """Offline default scorer inside the JVM; never fails."""
    score = scoring.overlap_score(
        tokenize(scoring.rerank_query(F.col("query")), compatibility),
        tokenize(scoring.rerank_text(F.col("chapter_title"), F.col("text")), compatibility),
    )
    return items.withColumns({"rerank_score": F.round(score, SCORE_DIGITS), "reranked": F.lit(True)})


def rerank(
    items: DataFrame, make_scorer: Callable[[], Scorer], batch_size: int = RERANK_BATCH,
    max_candidates: int | None = RERANK_MAX_CANDIDATES, timeout_seconds: float = RERANK_TIMEOUT_SECONDS,
) -> DataFrame:
    """Score (query, candidate) pairs with a plug-in model; adds rerank_score, reranked and rerank_error.

    A failing or late call makes its whole query fall back: `reranked` is
    false, `rerank_score` null and `rerank_error` the reason for all its items.
    Candidates are counted first, so a query over the limit is not scored; with
    `max_candidates=None` there is no limit and nothing to count.
    """
    size = F.lit(0) if max_candidates is None else F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    pairs = items.withColumns(
        {"_asked": scoring.rerank_query(F.col("query")), "_given": scoring.rerank_text(F.col("chapter_title"), F.col("text")), "_size": size}
    )
    schema = T.StructType(
        pairs.schema.fields + [T.StructField("rerank_score", T.DoubleType()), T.StructField("_reason", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        # one call at a time; a late one is left behind with its thread
        pool = ThreadPoolExecutor(1)
        for batch in batches:
            # one model call never mixes queries, so a failure stays with its query
            for _, group in batch.groupby("query_id", sort=False, dropna=False):
                reason = "too many candidates" if max_candidates is not None and group["_size"].iloc[0] > max_candidates else None
                until = time.monotonic() + timeout_seconds
                for at in range(0, len(group), batch_size):
                    part = group.iloc[at: at + batch_size]
                    found = float("nan")
                    if reason is None:
                        try:
                            scorer = scorer or make_scorer()
                            call = pool.submit(scorer, list(zip(part["_asked"], part["_given"])))
                            found = [float(s) for s in call.result(max(0.0, until - time.monotonic()))]
                            if len(found) != len(part):
                                raise ValueError("scores do not match candidates")
                        except Exception as error:
                            found, reason = float("nan"), f"{type(error).__name__}: {error}"
                            if isinstance(error, FutureTimeout) and not call.done():
                                pool.shutdown(wait=False)
                                pool, scorer = ThreadPoolExecutor(1), None
                    yield part.assign(rerank_score=found, _reason=reason)
        pool.shutdown(wait=False)

    scored = pairs.mapInPandas(run, schema)
    state = scored.groupBy("query_id").agg(F.min("_reason").alias("rerank_error"))
    out = scored.join(state.withColumnRenamed("query_id", "_q"), F.col("query_id").eqNullSafe(F.col("_q")))
    return out.withColumn("reranked", F.col("rerank_error").isNull()).withColumn(
        "rerank_score", F.when(F.col("reranked"), F.col("rerank_score"))
    ).drop("_reason", "_asked", "_given", "_size", "_q")


def join_scores(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of an outside scorer by item id; an unknown id fails its query."""
    unknown = scores.join(items.select("query_id", "book_id"), ["query_id", "book_id"], "left_anti")
    bad = unknown.select("query_id").distinct().withColumn("_bad", F.lit(True))
    good = items.join(scores.select("query_id", "book_id", "rerank_score"), ["query_id", "book_id"], "left").join(
        bad, "query_id", "left"
    )
    ok = F.col("_bad").isNull()
    kept = good.filter(~ok | F.col("rerank_score").isNotNull())
    return kept.withColumns(
        {"rerank_score": F.when(ok, F.col("rerank_score")), "reranked": ok}
    ).drop("_bad")


def rerank_top_k(items: DataFrame, k: int | None = None, max_candidates: int = RERANK_MAX_CANDIDATES) -> DataFrame:
    """Best min(k, n) items per query, ties in input order; more than `max_candidates` for a query is an error."""
    limit = k or RERANK_TOP_K
    whole = Window.partitionBy("query_id")
    checked = items.withColumn("_size", F.count(F.lit(1)).over(whole))
    problem = F.raise_error(F.concat(F.lit("too many candidates: "), F.col("_size").cast("string"))).cast("int")
    place = F.when(F.col("_size") > max_candidates, problem).otherwise(
        F.row_number().over(whole.orderBy(F.desc("rerank_score"), F.asc("position")))
    )
    return checked.withColumn("rerank_rank", place).filter(F.col("rerank_rank") <= limit).drop("_size")


def policy_score(items: DataFrame) -> Column:
    return F.round(
        scoring.ranked_book_score(
            F.col("score"), F.col("rerank_score"), F.col("overlap"), F.col("demote"), F.col("front_matter")
        ),
        SCORE_DIGITS,
    )


def rank_books(items: DataFrame) -> DataFrame:
    """0-based `position` by policy score, then fused score, then book id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("policy_score"), F.desc("score"), F.asc("book_id"))
    return items.withColumn("policy_score", policy_score(items)).withColumn("position", F.row_number().over(w) - 1)


def page_of(ranked: DataFrame, offset: Column, limit: int = PAGE_LIMIT) -> DataFrame:
    """Rows of the page by `position`, with `next_offset`.

    Needs `total` (ranked books of the query) and `more_after` (books known
    to follow the ranked ones) on every row.
    """
    start = offset
    shown = F.greatest(F.least(F.col("total") - start, F.lit(limit)), F.lit(0))
    last = start + shown
    more = (F.col("total") > last) | (F.col("more_after") & (shown > 0))
    return ranked.filter((F.col("position") >= start) & (F.col("position") < start + limit)).withColumn(
        "next_offset", F.when(more, last.cast("int"))
    )


def final_order(page: DataFrame) -> DataFrame:
    """Order inside the page: rerank score or fused score, then book id."""
    shown = F.coalesce("rerank_score", "score")
    w = Window.partitionBy("query_id", "offset").orderBy(shown.desc(), F.col("book_id").cast("string").asc())
    return page.withColumn("page_rank", F.row_number().over(w))
