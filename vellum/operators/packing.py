"""Packing consecutive small chapters into batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.constants import BATCH_BYTES, BATCH_CHAPTERS, SMALL_CHAPTER_BYTES
from vellum.operators.ordered import running_totals
from vellum.session import union_all


def stored_json(chapter_id: Column, title: Column, index: Column, html: Column) -> Column:
    return F.to_json(
        F.struct(
            chapter_id.alias("chapterId"), title.alias("chapterTitle"), index.cast("int").alias("chapterIndex"),
            F.coalesce(html, F.lit("")).alias("html"),
        )
    )


def stored_bytes(json: Column) -> Column:
    """UTF-8 size of the stored line with its line end."""
    return F.octet_length(json) + 1


def pack_chapters(
    chapters: DataFrame, book: str = "book_id", order: str = "chapter_index", size: str = "json_bytes",
    small_bytes: int = SMALL_CHAPTER_BYTES, batch_chapters: int = BATCH_CHAPTERS, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Adds `batch_index` (null for chapters stored alone), counted per book from 1.

    Large chapters cut the sequence into islands; inside an island every
    `batch_chapters` small chapters make a batch. While the byte limit cannot
    bind this is arithmetic on running totals, so a book of any length is
    spread over tasks. Only where it can bind, the sizes (not the chapters) of
    one island are folded in order.
    """
    small_bytes, batch_chapters, batch_bytes = max(256, small_bytes), max(2, batch_chapters), max(2048, batch_bytes)
    small = F.col(size) <= small_bytes
    counted = running_totals(
        chapters, [book], [order],
        {"_island": F.when(small, 0).otherwise(1), "_small_no": F.when(small, 1).otherwise(0)},
    )
    smalls = counted.filter(small)
    first = smalls.groupBy(book, "_island").agg(F.min("_small_no").alias("_first"))
    placed = smalls.join(first, [book, "_island"]).withColumn("_at", F.col("_small_no") - F.col("_first"))
    if batch_chapters * small_bytes <= batch_bytes:
        local = placed.withColumn("_batch", F.floor(F.col("_at") / batch_chapters))
    else:
        fold = _fold_sizes(placed.select(book, "_island", "_at", size), book, size, batch_chapters, batch_bytes)
        local = placed.join(fold, [book, "_island", "_at"])
    # batches are numbered per book over its islands: count those of earlier islands
    per_island = local.groupBy(book, "_island").agg((F.max("_batch") + 1).alias("_n"))
    before = running_totals(per_island, [book], ["_island"], {"_upto": F.col("_n")}).select(
        book, "_island", (F.col("_upto") - F.col("_n")).alias("_before")
    )
    numbered = local.join(before, [book, "_island"]).select(
        *chapters.columns, (F.col("_before") + F.col("_batch") + 1).cast("int").alias("batch_index")
    )
    alone = counted.filter(~small).select(*chapters.columns, F.lit(None).cast("int").alias("batch_index"))
    return union_all(numbered, alone)


def _fold_sizes(sizes: DataFrame, book: str, size: str, batch_chapters: int, batch_bytes: int) -> DataFrame:
    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_at")
        out, current, count, held = [], 0, 0, 0
        for bytes_ in batch[size]:
            if count and (count >= batch_chapters or held + bytes_ > batch_bytes):
                current, count, held = current + 1, 0, 0
            out.append(current)
            count, held = count + 1, held + bytes_
            if count >= batch_chapters or held >= batch_bytes:
                current, count, held = current + 1, 0, 0
        return batch[[book, "_island", "_at"]].assign(_batch=out)

    kind = sizes.schema[book].dataType.simpleString()
    return sizes.groupBy(book, "_island").applyInPandas(fold, f"{book} {kind}, _island long, _at long, _batch long")


def batch_manifest(packed: DataFrame, prefix: Column, book: str = "book_id") -> DataFrame:
    """One row per stored object: kind, name, bytes and its chapters in order."""
    from vellum.functions.keys import batch_object, chapter_object

    alone = packed.filter(F.col("batch_index").isNull()).select(
        book, F.lit("chapter").alias("kind"), F.lit(None).cast("int").alias("batch_index"),
        chapter_object(prefix, F.col("chapter_index"), F.col("chapter_id")).alias("object_name"),
        F.col("json_bytes").cast("long").alias("bytes"),
        F.array(F.struct(F.col("chapter_id").alias("chapterId"), F.col("chapter_index").cast("int").alias("chapterIndex"))).alias("chapters"),
    )
    entry = F.struct(F.col("chapter_index").cast("int").alias("chapterIndex"), F.col("chapter_id").alias("chapterId"))
    batches = (
        packed.filter(F.col("batch_index").isNotNull())
        .withColumn("_prefix", prefix)
        .groupBy(book, "batch_index", "_prefix")
        # at most `batch_chapters` entries per group
        .agg(F.sort_array(F.collect_list(entry)).alias("_c"), F.sum(F.col("json_bytes") - 1).alias("_inner"), F.count(F.lit(1)).alias("_n"))
        .select(
            book, F.lit("batch").alias("kind"), "batch_index",
            batch_object(F.col("_prefix"), F.col("batch_index")).alias("object_name"),
            # {"batchIndex":n,"chapters":[a,b]} and the line end
            (F.col("_inner") + F.col("_n") - 1 + F.length(F.col("batch_index").cast("string")) + len('{"batchIndex":,"chapters":[]}') + 1).cast("long").alias("bytes"),
            F.transform("_c", lambda c: F.struct(c["chapterId"].alias("chapterId"), c["chapterIndex"].alias("chapterIndex"))).alias("chapters"),
        )
    )
    return union_all(alone, batches)


def stored_objects(manifest: DataFrame, chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, kind, batch_index, object_name, value): the JSON text of every object of a manifest, without its line end.

    `chapters(book, chapter_index, json)`. A batch is put together from at most
    `batch_chapters` small chapters, in order.
    """
    listed = manifest.select(book, "kind", "batch_index", "object_name", F.explode("chapters").alias("_c")).withColumn("chapter_index", F.col("_c.chapterIndex"))
    found = listed.join(chapters, [book, "chapter_index"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chapter_index", "json"))), lambda c: c["json"])
    grouped = found.groupBy(book, "kind", "batch_index", "object_name").agg(parts.alias("_p"))
    batch = F.concat(F.lit('{"batchIndex":'), F.col("batch_index").cast("string"), F.lit(',"chapters":['), F.array_join("_p", ","), F.lit("]}"))
    return grouped.select(book, "kind", "batch_index", "object_name", F.when(F.col("kind") == "batch", batch).otherwise(F.col("_p")[0]).alias("value"))


def manifest_problems(announced: DataFrame, stored: DataFrame) -> DataFrame:
    """Differences between announced and stored batches of chapters.

    Both: (book_id, batch_index, chapter_id, chapter_index). Counts are
    compared per batch, keys `id:index` both ways.
    """
    from vellum.operators.merges import differences

    keys = ["book_id", "batch_index", "chapter_id", "chapter_index"]
    counts = (
        announced.groupBy("book_id", "batch_index").agg(F.count(F.lit(1)).alias("announced"))
        .join(stored.groupBy("book_id", "batch_index").agg(F.count(F.lit(1)).alias("stored")), ["book_id", "batch_index"], "full")
        .filter(~F.col("announced").eqNullSafe(F.col("stored")))
        .select("book_id", "batch_index", F.lit(None).cast("string").alias("chapter_id"),
                F.lit(None).cast("int").alias("chapter_index"), F.lit("count").alias("problem"))
    )
    return union_all(differences(announced, stored, keys), counts)
