"""Rerank snapshots: a table keyed by query, with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.constants import CACHE_TTL_SECONDS, CACHE_WINDOW
from vellum.functions.keys import snapshot_key
from vellum.functions.text import normalize_query
from vellum.operators.merges import keep_last

ITEM = (
    "book_id string, score double, rerank_score double, cover_s3_file_path string, "
    "match struct<id:string,chapter_id:string,chapter_index:int,chapter_title:string,chunk_index:int,"
    "text:string,source_start_char:int,source_end_char:int>"
)


def with_key(queries: DataFrame, window: int = CACHE_WINDOW, compatibility: bool = True) -> DataFrame:
    return queries.withColumn("cache_key", snapshot_key(normalize_query(F.col("query"), compatibility), window))


def usable(snapshots: DataFrame, now: Column, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Newest entry of each key that is alive and whose items are all valid."""
    alive = keep_last(snapshots, ["cache_key"], [F.col("written_at")]).filter(
        F.unix_micros("written_at") + F.lit(ttl_seconds * 1_000_000) > F.unix_micros(now)
    )

    def valid(i: Column) -> Column:
        m = i["match"]
        texts = [i["book_id"], m["id"], m["chapter_id"], m["chapter_title"], m["text"]]
        ok = i["score"].isNotNull() & m["chapter_index"].isNotNull() & m["chunk_index"].isNotNull()
        for t in texts:
            ok = ok & F.coalesce(F.length(t) > 0, F.lit(False))
        cover = i["cover_s3_file_path"]
        return ok & (cover.isNull() | (F.length(cover) > 0))

    return alive.filter(F.col("items").isNotNull() & F.col("has_more_after_window").isNotNull() & F.forall("items", valid))


def split_by_snapshot(queries: DataFrame, snapshots: DataFrame, now: Column, ttl_seconds: int = CACHE_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(queries with their snapshot, queries without one); needs `cache_key`."""
    live = usable(snapshots, now, ttl_seconds)
    hits = queries.join(live.select("cache_key", "items", "has_more_after_window"), "cache_key")
    return hits, queries.join(live.select("cache_key"), "cache_key", "left_anti")


def snapshot_rows(ranked: DataFrame, now: Column) -> DataFrame:
    """New entries from ranked items; queries that fell back write none.

    `ranked` has cache_key, position, more_after, reranked and the item
    columns; a query holds at most the window's items.
    """
    item = F.struct(
        "position", F.col("book_id").cast("string").alias("book_id"), "score", "rerank_score", "cover_s3_file_path",
        F.struct(
            F.col("point_id").cast("string").alias("id"), F.col("chapter_id").cast("string").alias("chapter_id"),
            F.col("chapter_index").cast("int").alias("chapter_index"), "chapter_title",
            F.col("chunk_index").cast("int").alias("chunk_index"), "text",
            F.col("source_start_char").cast("int").alias("source_start_char"),
            F.col("source_end_char").cast("int").alias("source_end_char"),
        ).alias("match"),
    )
    ordered = F.sort_array(F.collect_list(item))
    return ranked.filter("reranked").groupBy("cache_key").agg(
        F.transform(ordered, lambda i: i.dropFields("position")).cast(f"array<struct<{_struct(ITEM)}>>").alias("items"),
        F.bool_or("more_after").alias("has_more_after_window"),
    ).withColumn("written_at", now)


def _struct(ddl: str) -> str:
    return ", ".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in ddl.split(", "))
