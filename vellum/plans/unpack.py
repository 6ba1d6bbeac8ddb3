"""Archives to chapters, stored objects, covers and events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.html import chapter_html, chapter_plain_text, cover_figure, slice_by_anchors, title_hint
from vellum.functions.keys import cover_object, data_url, media_extension, target_prefix
from vellum.functions.text import resolve_title
from vellum.operators.covers import cover_items, entry_names, find_entries
from vellum.operators.packing import batch_manifest, pack_chapters, stored_bytes, stored_json, stored_objects
from vellum.operators.toc import best_toc_titles, chapter_descriptors, flow_items
from vellum.session import stage_table, union_all
from vellum.sources import archives as src
from vellum.sources.events import build_events, event_name_id


@dataclass
class Unpacked:
    books: DataFrame
    chapters: DataFrame
    objects: DataFrame
    manifest: DataFrame
    covers: DataFrame
    events: DataFrame
    plans: DataFrame
    errors: DataFrame


@dataclass
class Contents:
    """What the packages of archives list, staged: small tables that several steps join; only `entries` holds bytes."""

    items: DataFrame
    flow: DataFrame
    names: DataFrame
    entries: DataFrame


def contents_of(parsed: DataFrame) -> Contents:
    items = stage_table(src.manifest(parsed))
    files = src.entries(parsed)
    return Contents(items, stage_table(flow_items(src.spine(parsed), items)), stage_table(entry_names(files)), files)


def extract_chapters(parsed: DataFrame, covers: DataFrame, inject_cover: bool = True, contents: Contents | None = None) -> tuple[DataFrame, DataFrame]:
    """(chapters, chapters skipped with a reason) of parsed archives.

    The ordinal is given before bad chapters drop out, so numbers have gaps.
    """
    known = contents or contents_of(parsed)
    items = known.items
    described = chapter_descriptors(known.flow, best_toc_titles(src.toc(parsed)))
    placed = described.join(items.select("book_id", F.col("id").alias("source_id"), F.col("href").alias("path")), ["book_id", "source_id"], "left")
    # staged as bytes of the chosen entries only: errors, chapters and first chapters all read it
    read = stage_table(find_entries(placed, known.entries, known.names))
    missing = F.col("data").isNull()
    skipped = read.filter(missing).select(
        "book_id", "chapter_index", "chapter_id", F.concat(F.lit("Archive entry not found: "), F.col("path")).alias("error")
    )
    sliced = read.filter(~missing).withColumn(
        "_part", slice_by_anchors(F.col("data").cast("string"), F.col("start_anchor"), F.col("end_anchor"))
    )
    chapters = sliced.select(
        "book_id", "chapter_index", "chapter_id",
        resolve_title(F.col("title"), F.col("chapter_index"), title_hint(F.col("_part"))).alias("chapter_title"),
        chapter_html(F.col("_part")).alias("html"),
        F.length(chapter_plain_text(F.col("_part"))).alias("plain_text_chars"),
        (F.coalesce(F.length("start_anchor"), F.length("end_anchor"), F.lit(0)) > 0).alias("is_anchored"),
    )
    if inject_cover:
        first = read.filter(~missing).groupBy("book_id").agg(F.min("chapter_index").alias("chapter_index"))
        figure = covers.select("book_id", cover_figure(data_url(F.col("media_type"), F.col("bytes"))).alias("_figure"))
        chapters = chapters.join(first.join(figure, "book_id"), ["book_id", "chapter_index"], "left").withColumn(
            "html", F.concat(F.coalesce("_figure", F.lit("")), F.col("html"))
        ).drop("_figure")
    return chapters, skipped


def cover_assets(parsed: DataFrame, prefixes: DataFrame, contents: Contents | None = None) -> DataFrame:
    """(book_id, object_key, media_type, bytes) of the books that have a cover."""
    known = contents or contents_of(parsed)
    items, files = known.items, known.entries
    chosen = cover_items(src.cover_references(parsed), items, known.flow, files, known.names)
    images = chosen.join(items.select("book_id", F.col("id").alias("item_id"), F.col("href").alias("path"), "media_type"), ["book_id", "item_id"])
    found = find_entries(images, files, known.names).filter(F.col("data").isNotNull() & F.col("media_type").startswith("image/"))
    return found.join(prefixes, "book_id").select(
        "book_id", cover_object(F.col("prefix"), media_extension(F.col("path"), F.col("media_type"))).alias("object_key"),
        "media_type", F.col("data").alias("bytes"),
    )


def unpack_books(archives: DataFrame, bucket: str, inject_cover: bool = True) -> Unpacked:
    """Unpack `archives(book_id, object_name, content[, target_prefix])`."""
    parsed = stage_table(src.parse_archives(archives), ["kind"])
    given = F.col("target_prefix") if "target_prefix" in archives.columns else None
    prefixes = archives.select("book_id", target_prefix(F.col("object_name"), given).alias("prefix"))
    contents = contents_of(parsed)
    covers = stage_table(cover_assets(parsed, prefixes, contents))
    chapters, skipped = extract_chapters(parsed, covers, inject_cover, contents)
    chapters = stage_table(chapters)

    json = stored_json(F.col("chapter_id"), F.col("chapter_title"), F.col("chapter_index"), F.col("html"))
    sized = chapters.select("book_id", "chapter_id", "chapter_index", stored_bytes(json).alias("json_bytes"))
    packed = stage_table(pack_chapters(sized))
    manifest = batch_manifest(packed.join(prefixes, "book_id"), F.col("prefix"))
    objects = stored_objects(manifest, chapters.select("book_id", "chapter_index", json.alias("json")))

    cover_keys = covers.select("book_id", F.col("object_key").alias("cover"), "media_type")
    located = manifest.join(cover_keys, "book_id", "left")
    book = F.col("book_id").cast("string")
    single = located.filter(F.col("kind") == "chapter")
    batch = located.filter(F.col("kind") == "batch")
    events = union_all(union_all(build_events(
        single, "ChapterExtracted",
        {"bookId": book, "chapterId": F.col("chapters")[0]["chapterId"], "chapterIndex": F.col("chapters")[0]["chapterIndex"],
         "bucket": F.lit(bucket), "s3FilePath": F.col("object_name"), "coverS3FilePath": F.col("cover")},
        event_name_id(F.lit("ChapterExtracted"), book, F.col("object_name")),
    ), build_events(
            batch, "ChapterBatchExtracted",
            {"bookId": book, "batchIndex": F.col("batch_index"), "bucket": F.lit(bucket), "s3FilePath": F.col("object_name"),
             "coverS3FilePath": F.col("cover"), "chaptersCount": F.size("chapters"), "chapters": F.col("chapters")},
            event_name_id(F.lit("ChapterBatchExtracted"), book, F.col("object_name")),
        )), build_events(
            cover_keys, "BookCoverExtracted",
            {"bookId": book, "bucket": F.lit(bucket), "s3FilePath": F.col("cover"), "contentType": F.col("media_type")},
            event_name_id(F.lit("BookCoverExtracted"), book, F.col("cover")),
        ))
    plans = chapters.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("expected"))
    books = src.book_metadata(parsed).join(cover_keys.select("book_id", "cover"), "book_id", "left")
    errors = union_all(skipped.select("book_id", "chapter_index", "error"), src.failures(parsed).select("book_id", F.lit(None).cast("int").alias("chapter_index"), "error"))
    return Unpacked(books, chapters, objects, manifest, covers, events, plans, errors)
