"""From package lists to chapter descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.keys import fragment_of, normalize_href, segment_chapter_id, toc_target
from vellum.functions.text import strip, toc_title_score
from vellum.operators.merges import keep_first


def flow_items(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine references that exist in the manifest, renumbered from 0 in order.

    One book's lists come from one archive of bounded size, so windows per
    book are small.
    """
    items = manifest.select("book_id", "id", "href", "media_type")
    joined = spine.select("book_id", F.col("pos").alias("_pos"), "id").join(items, ["book_id", "id"])
    w = Window.partitionBy("book_id").orderBy("_pos")
    return joined.withColumn("pos", F.row_number().over(w) - 1).drop("_pos")


def flow_chapters(flow: DataFrame) -> DataFrame:
    """Flow items that hold chapter markup."""
    kind = F.col("media_type")
    return flow.filter((F.length("id") > 0) & (kind.isNull() | F.contains(kind, F.lit("xhtml"))))


def best_toc_titles(entries: DataFrame) -> DataFrame:
    """One entry per target: best title score, then longest, then first seen.

    `entries(book_id, pos, href, title)` is the union of all tables of contents
    in source order; the position of a target is that of its first entry.
    """
    named = (
        entries.withColumns({"title": strip(F.col("title")), "target": toc_target(F.col("href"))})
        .filter((F.length("title") > 0) & (F.length("target") > 0))
        .withColumn("_score", toc_title_score(F.col("title")))
    )
    better = F.struct(-F.col("_score"), -F.length("title"), F.col("pos"))
    return named.groupBy("book_id", "target").agg(
        F.min_by("title", better).alias("title"), F.min("pos").alias("pos")
    ).withColumnRenamed("target", "href")


def toc_segments(toc: DataFrame) -> DataFrame:
    """Usable entries per file: ordered, one per anchor, with the next anchor."""
    usable = (
        toc.withColumns({"title": strip(F.col("title")), "source_href": normalize_href(F.col("href")), "anchor": fragment_of(F.col("href"))})
        .filter((F.length("title") > 0) & (toc_title_score(F.col("title")) >= 0) & (F.length("source_href") > 0))
        .withColumn("_key", F.coalesce("anchor", F.lit("")))
    )
    single = keep_first(usable.select("book_id", "source_href", "_key", "anchor", "title", "pos"), ["book_id", "source_href", "_key"], [F.col("pos")])
    w = Window.partitionBy("book_id", "source_href").orderBy("pos")
    return single.select(
        "book_id", "source_href", "title", F.col("anchor").alias("start_anchor"),
        F.lead("anchor").over(w).alias("end_anchor"), (F.row_number().over(w) - 1).alias("segment"),
    )


def chapter_descriptors(flow: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters of every book with their 1-based ordinal and anchors."""
    chapters = flow_chapters(flow).select(
        "book_id", F.col("pos").alias("spine_pos"), F.col("id").alias("source_id"),
        normalize_href(F.col("href")).alias("source_href"),
    )
    joined = chapters.join(toc_segments(toc), ["book_id", "source_href"], "left")
    segment = F.coalesce("segment", F.lit(0))
    w = Window.partitionBy("book_id").orderBy("spine_pos", segment)
    return joined.select(
        "book_id",
        F.row_number().over(w).alias("chapter_index"),
        F.when(F.col("segment").isNull(), F.col("source_id")).otherwise(
            segment_chapter_id(F.col("source_id"), F.col("start_anchor"), segment)
        ).alias("chapter_id"),
        "source_id", "source_href", "start_anchor", "end_anchor",
        F.coalesce("title", F.concat(F.lit("Chapter "), (F.col("spine_pos") + 1).cast("string"))).alias("title"),
    )
