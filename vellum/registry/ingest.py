"""Archives, chapters, packing and chunking."""

from __future__ import annotations

import base64
import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from vellum.constants import BLOCK_TAGS, NOISE_CONTAINERS, NOISE_VOID, SMALL_CHAPTER_BYTES
from vellum.functions.html import html_to_text
from vellum.functions.keys import target_prefix
from vellum.functions.text import tidy_paragraphs
from vellum.operators import covers, packing, toc
from vellum.operators.chunking import indexable, split_to_rows, with_context
from vellum.plans.unpack import unpack_books
from vellum.plans.vectorize import chunk_chapters, vectorize
from vellum.registry import Registry, table
from vellum.registry.scalars import html_text_sql, paragraphs_sql
from vellum.session import checkpoint_folder, stage_table, union_all
from vellum.sources import archives as src
from vellum.sources.object_store import cover_store, object_store
from vellum.sources.stored import parse_batches, parse_chapters
from vellum.sources.events import build_events, event_name_id, file_stream, route_outbox
from vellum.streaming.envelope import with_payload
from vellum.streaming.runners import unpack_stream, vectorize_stream, write_batch

R = Registry()

PIXEL = bytes.fromhex("89504e470d0a1a0a0000000d49484452")


def make_archive(book: int, page: str) -> bytes:
    """A small book: one page with two anchors, one plain chapter, one missing file."""
    opened = page.replace("<h1>", '<h1 id="top">', 1).replace("<footer>", '<footer id="end">', 1)
    if book % 3 == 2:
        opened = opened.replace('<h1 id="top">', '<img src="../img/x.png"/><h1 id="top">', 1)
    meta = '<meta name="cover" content="pic"/>' if book % 3 == 0 else ""
    flag = ' properties="cover-image"' if book % 3 == 1 else ""
    files = {
        "META-INF/container.xml": '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
        "OEBPS/book.opf": f"""<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
            <dc:title> Book  {book} </dc:title><dc:creator>Writer {book % 7}</dc:creator>{meta}</metadata>
            <manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
            <item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="text/C%32.xhtml" media-type="application/xhtml+xml"/>
            <item id="c3" href="text/gone.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="img/x.png" media-type="image/png"{flag}/><item id="nohref"/></manifest>
            <spine toc="ncx"><itemref idref="c1"/><itemref idref="unknown"/><itemref idref="c2"/><itemref idref="c3"/></spine></package>""",
        "OEBPS/toc.ncx": '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Op</text></navLabel><content src="text/c1.xhtml#top"/></navPoint></navMap></ncx>',
        "OEBPS/nav.xhtml": f'<html><body><nav epub:type="toc"><ol><li><a href="text/c1.xhtml#top">Opening {book}</a></li><li><a href="text/c1.xhtml#end">Closing <i>words</i></a></li><li><a href="text/c1.xhtml#p3">Pg. 3</a></li></ol></nav></body></html>',
        "OEBPS/text/c1.xhtml": opened,
        "OEBPS/Text/c2.xhtml": f'<html><head><title>t</title></head><body><h2>Second {book}</h2><p>Body of {book}.</p><img src="../img/x.png"/></body></html>',
        "OEBPS/img/x.png": PIXEL,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in files.items():
            archive.writestr(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def archives(spark, sf):
    """One archive per page, built in the tasks that read the pages."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids = batch.column("page_id").slice(at, 128)
                made = [make_archive(i, h) for i, h in zip(ids.to_pylist(), batch.column("html").slice(at, 128).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([f"in/Book {i}.epub" for i in ids.to_pylist()]), pa.array(made, pa.binary())], ["book_id", "object_name", "content"])

    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.mapInArrow(build, "book_id long, object_name string, content binary")


def unpacked(spark, sf):
    return unpack_books(archives(spark, sf), "books-bucket")


# --- archives ---------------------------------------------------------------------------------
@R.add("g4_archive_parse", """
  SELECT kind, n * (SELECT count(*) FROM pages) AS rows_ FROM (VALUES ('entry', 7), ('package', 1), ('title', 1), ('creator', 1), ('manifest', 6), ('spine', 4), ('toc', 4)) AS v(kind, n)
  UNION ALL SELECT 'cover', count(*) FROM pages WHERE page_id % 3 = 0""")
def g4(spark, sf):
    return src.parse_archives(archives(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("rows_"))


@R.add("s2_entry_lookup", "SELECT page_id AS book_id, p AS path, o AS found FROM pages, (VALUES ('OEBPS/book.opf', true), ('oebps/./BOOK.opf', true), ('OEBPS/text/C%32.xhtml', true), ('OEBPS/nope', false)) AS v(p, o)")
def s2(spark, sf):
    entries = src.entries(stage_table(src.parse_archives(archives(spark, sf)), ["kind"]))
    wanted = F.array(*map(F.lit, ["OEBPS/book.opf", "oebps/./BOOK.opf", "OEBPS/text/C%32.xhtml", "OEBPS/nope"]))
    paths = table(spark, sf, "pages").select(F.col("page_id").alias("book_id"), F.explode(wanted).alias("path"))
    return covers.find_entries(paths, entries).select("book_id", "path", F.col("data").isNotNull().alias("found"))


@R.add("s3_package_lists", """
  SELECT page_id AS book_id, 'Book ' || page_id AS title, 'Writer ' || page_id % 7 AS creator, 6::BIGINT AS items, 4::BIGINT AS refs FROM pages""")
def s3(spark, sf):
    parsed = stage_table(src.parse_archives(archives(spark, sf)), ["kind"])
    items = src.manifest(parsed).groupBy("book_id").agg(F.count(F.lit(1)).alias("items"))
    refs = src.spine(parsed).groupBy("book_id").agg(F.count(F.lit(1)).alias("refs"))
    return src.book_metadata(parsed).join(items, "book_id").join(refs, "book_id").select("book_id", "title", "creator", "items", "refs")


_ANCHORED = "replace(replace(html, '<h1>', '<h1 id=\"top\">'), '<footer>', '<footer id=\"end\">')"


@R.add("p1_unpack_books", """
  SELECT page_id AS book_id, 1 AS chapter_index, 'c1:a:top:1' AS chapter_id, 'Opening ' || page_id AS chapter_title, page_id % 3 <= 2 AS has_cover FROM pages
  UNION ALL SELECT page_id, 2, 'c1:a:end:2', 'Closing words', false FROM pages
  UNION ALL SELECT page_id, 3, 'c2', 'Second ' || page_id, false FROM pages""")
def p1(spark, sf):
    return unpacked(spark, sf).chapters.select("book_id", "chapter_index", "chapter_id", "chapter_title", F.contains("html", F.lit("<figure>")).alias("has_cover"))


@R.add("w1_skipped_chapters", "SELECT page_id AS book_id, 4 AS chapter_index, 'Archive entry not found: OEBPS/text/gone.xhtml' AS error FROM pages")
def w1_skipped(spark, sf):
    return unpacked(spark, sf).errors.select("book_id", "chapter_index", "error")


@R.add("g5_cover_resolution", """
  SELECT page_id AS book_id, 'books/book-' || page_id || '/cover/original.png' AS object_key, 'image/png' AS media_type, 16::BIGINT AS bytes FROM pages""")
def g5(spark, sf):
    """The cover by meta, by property, or by the image a first document shows; stored as S6 does."""
    return unpacked(spark, sf).covers.select("book_id", "object_key", "media_type", F.octet_length("bytes").cast("long").alias("bytes"))


_P1 = """
  SELECT page_id AS book_id, 1 AS chapter_index, 'c1:a:top:1' AS chapter_id FROM pages UNION ALL SELECT page_id, 2, 'c1:a:end:2' FROM pages UNION ALL SELECT page_id, 3, 'c2' FROM pages"""


@R.add("t9_unpack_events", f"{_P1} UNION ALL SELECT page_id, 0, 'cover' FROM pages")
def t9_events(spark, sf):
    """What all events announce: each chapter once, alone or in a batch, and each cover."""
    e = unpacked(spark, sf).events
    book = F.col("p.bookId").cast("long").alias("book_id")
    alone = with_payload(e, "ChapterExtracted").select(book, F.col("p.chapterIndex").alias("chapter_index"), F.col("p.chapterId").alias("chapter_id"))
    batch = with_payload(e, "ChapterBatchExtracted").select("p", F.explode("p.chapters").alias("c")).select(
        book, F.col("c.chapterIndex").alias("chapter_index"), F.col("c.chapterId").alias("chapter_id"))
    cover = with_payload(e, "BookCoverExtracted").select(book, F.lit(0).alias("chapter_index"), F.lit("cover").alias("chapter_id"))
    return union_all(union_all(alone, batch), cover)


def _folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("s1_archive_scan", "SELECT 'book-' || page_id || '.epub' AS name, true AS same FROM pages")
def s1(spark, sf):
    """Archives written to a folder and found again by name, with their content."""
    made = stage_table(archives(spark, sf))
    folder = _folder(spark, "archives")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(path, recursive=True)
        for batch in batches:
            for book, content in zip(batch["book_id"], batch["content"]):
                with store.open_output_stream(f"{path}/book-{book}.epub") as out:
                    out.write(content)
            yield batch[["book_id"]]

    made.mapInPandas(save, "book_id long").count()
    found = src.scan_archives(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    wanted = made.select(F.concat(F.lit("book-"), F.col("book_id").cast("string"), F.lit(".epub")).alias("name"), F.sha2("content", 256).alias("wanted"))
    return found.join(wanted, "name", "left").select("name", F.coalesce(F.col("digest") == F.col("wanted"), F.lit(False)).alias("same"))


def _twice(rows, folder):
    """Every message delivered twice, over several micro-batches."""
    sent = route_outbox(rows)
    union_all(sent, sent).repartition(3).write.parquet(f"{folder}/messages")
    return file_stream(rows.sparkSession, f"{folder}/messages")


@R.add("t9_unpack_stream", f"{_P1} UNION ALL SELECT page_id, 0, 'dead' FROM pages WHERE page_id % 5 = 0")
def t9_stream(spark, sf):
    """BookUploaded messages, each delivered twice, some without a bucket: chapters once, the broken ones in the dead-letter log."""
    folder = _folder(spark, "unpack")
    made = stage_table(archives(spark, sf))
    book = F.col("book_id").cast("string")
    good = build_events(made, "BookUploaded", {"bookId": book, "bucket": F.lit("books"), "objectName": F.col("object_name")}, event_name_id(F.lit("up"), book))
    bad = good.filter("aggregate_id % 5 = 0").withColumns({"id": F.concat(F.lit("bad-"), F.col("id")), "payload": F.lit("{}")})

    def sink(out, number):
        write_batch(out.chapters.select("book_id", "chapter_index", "chapter_id"), f"{folder}/chapters", number)

    query = unpack_stream(_twice(union_all(good, bad), folder), lambda u: u.join(made.select("book_id", "content"), "book_id").select("book_id", "object_name", "content"), "books", sink, folder)
    query.awaitTermination()
    dead = spark.read.parquet(f"{folder}/dead").select("id").distinct()
    named = bad.select("id", F.col("aggregate_id").cast("long").alias("book_id")).join(dead, "id")
    return union_all(spark.read.parquet(f"{folder}/chapters").drop("batch"), named.select("book_id", F.lit(0).alias("chapter_index"), F.lit("dead").alias("chapter_id")))


def _opening_sql() -> str:
    """big(book_id, big): whether the stored JSON of a book's first chapter exceeds the limit of small ones."""
    figure = '<figure><img src="data:image/png;base64,' + base64.b64encode(PIXEL).decode() + '" alt="Book cover" loading="eager" decoding="async"/></figure>'
    s = """'<h1 id="top">' || regexp_extract(html, '(?s)<h1>(.*?)<footer>', 1)"""
    s = f"regexp_replace({s}, '(?i)<br\\s*/?>', chr(10), 'g')"
    s = f"regexp_replace({s}, '(?i)(</({BLOCK_TAGS})>)', '\\1' || chr(10), 'g')"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', '', 'g')"
    for tag in NOISE_CONTAINERS:
        s = f"regexp_replace({s}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    s = f"regexp_replace({s}, '(?i)</?({'|'.join(NOISE_VOID + NOISE_CONTAINERS)})\\b[^>]*>', '', 'g')"
    s = f"regexp_replace({s}, '(?i)</?a(\\s[^>]*)?>', '', 'g')"
    s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    rest = '{"chapterId":"c1:a:top:1","chapterTitle":"Opening ","chapterIndex":1,"html":}'
    return f"""big AS (SELECT page_id AS book_id, octet_length(encode(to_json('{figure}' || {s})::VARCHAR)) + {len(rest)} + length(page_id::VARCHAR) + 1 > {SMALL_CHAPTER_BYTES} AS big FROM pages)"""


@R.add("t10_vectorize_stream", f"""WITH {_opening_sql()}, c AS ({_P1})
  SELECT book_id, chapter_id, 'vectorized' AS state FROM c JOIN big USING (book_id) WHERE CASE WHEN chapter_index = 1 AND big THEN book_id % 2 = 0 ELSE book_id % 7 <> 3 END
  UNION ALL SELECT book_id, chapter_id, 'missing' FROM c JOIN big USING (book_id) WHERE CASE WHEN chapter_index = 1 AND big THEN book_id % 2 = 1 ELSE book_id % 7 = 3 AND chapter_id = 'c2' END""")
def t10_stream(spark, sf):
    """Extracted chapters, each message delivered twice. Of every seventh book a chapter of a batch is lost, and the batch is not vectorised; of every second one a chapter that is stored alone."""
    folder = _folder(spark, "vectorize")
    out = unpacked(spark, sf)
    announced = out.events.filter("type <> 'BookCoverExtracted'")
    place = out.manifest.select("book_id", "batch_index", F.col("object_name").alias("s3_file_path"), F.explode("chapters").alias("c")).select(
        "book_id", "batch_index", "s3_file_path", F.col("c.chapterIndex").alias("chapter_index"))
    kept = out.chapters.filter("not (book_id % 7 = 3 and chapter_id = 'c2')").select("book_id", "chapter_id", "chapter_index", "chapter_title", "html")
    objects = stage_table(kept.join(place, ["book_id", "chapter_index"]).filter("batch_index is not null or book_id % 2 = 0"))

    def load(asked):
        wanted = asked.select("book_id", "s3_file_path", "cover_s3_file_path").distinct()
        return objects.join(wanted, ["book_id", "s3_file_path"])

    def sink(done, events, number):
        write_batch(events.select("id", "payload", "type"), f"{folder}/events", number)

    vectorize_stream(_twice(announced, folder), load, sink, folder).awaitTermination()
    told = with_payload(spark.read.parquet(f"{folder}/events"), "ChapterVectorized")
    broken = spark.read.parquet(f"{folder}/broken").filter("problem = 'missing'")
    return union_all(
        told.select(F.col("p.bookId").cast("long").alias("book_id"), F.col("p.chapterId").alias("chapter_id"), F.lit("vectorized").alias("state")),
        broken.select("book_id", "chapter_id", F.lit("missing").alias("state")))


@R.add("s5_object_log", """
  SELECT page_id % 50 AS book_id, url AS object_name, length(CASE WHEN page_id % 3 = 0 THEN html || 'new' ELSE html END)::BIGINT AS chars FROM pages
  UNION ALL SELECT page_id % 50, 'copy of ' || url, length(html)::BIGINT FROM pages WHERE page_id % 5 = 0""")
def s5_log(spark, sf):
    """Objects in versions: a load, and a write of changed and new ones delivered twice; the last of each name holds."""
    pages = table(spark, sf, "pages")
    book = (F.col("page_id") % 50).alias("book_id")
    store = object_store(spark, _folder(spark, "objects"))
    store.write(pages.select(book, F.col("url").alias("object_name"), F.col("html").alias("value")))
    changed = pages.filter("page_id % 3 = 0").select(book, F.col("url").alias("object_name"), F.concat("html", F.lit("new")).alias("value"))
    added = pages.filter("page_id % 5 = 0").select(book, F.concat(F.lit("copy of "), F.col("url")).alias("object_name"), F.col("html").alias("value"))
    for _ in range(2):
        store.write(union_all(changed, added), 1)
    return store.read().select("book_id", "object_name", F.length("value").cast("long").alias("chars"))


@R.add("s6_cover_log", """
  SELECT page_id // 3 AS book_id, CASE WHEN bool_or(page_id % 2 = 1) THEN 'odd/' || max(page_id) FILTER (page_id % 2 = 1) ELSE 'even/' || max(page_id) END AS object_key FROM pages GROUP BY 1""")
def s6_log(spark, sf):
    """One cover per book: those of even pages, and then, for the books that have them, those of odd ones on top of a compacted base."""
    pages = table(spark, sf, "pages")
    covers = lambda odd, name: pages.filter(f"page_id % 2 = {odd}").groupBy(F.floor(F.col("page_id") / 3).cast("long").alias("book_id")).agg(F.max("page_id").alias("p")).select(
        "book_id", F.concat(F.lit(name), F.col("p").cast("string")).alias("object_key"), F.lit("image/png").alias("media_type"), F.lit(PIXEL).alias("bytes"))
    store = cover_store(spark, _folder(spark, "covers"))
    store.write(covers(0, "even/"))
    store.compact()
    store.write(covers(1, "odd/"))
    return store.read().select("book_id", "object_key")


@R.add("s5_stored_objects", f"SELECT *, true AS same_bytes FROM ({_P1})")
def s5(spark, sf):
    """Stored objects read back: every chapter once, and each object as long as its manifest says."""
    out = unpacked(spark, sf)
    sized = out.objects.join(out.manifest.select("object_name", F.col("bytes").alias("announced")), "object_name").select(
        "book_id", "kind", "value", (F.octet_length("value") + 1 == F.col("announced")).alias("same_bytes"))
    alone, _ = parse_chapters(sized.filter("kind = 'chapter'"))
    batch, _ = parse_batches(sized.filter("kind = 'batch'"))
    columns = ["book_id", F.col("chapterIndex").alias("chapter_index"), F.col("chapterId").alias("chapter_id"), "same_bytes"]
    return union_all(alone.select(*columns), batch.select(*columns))


# --- spine and table of contents --------------------------------------------------------------
def _lists(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    n = k.cast("string")
    # a book is a part of a source: as an archive does, it holds a bounded number of chapters
    book = F.concat_ws("-", "source", F.floor(k / 400).cast("string")).alias("book_id")
    spine = d.select(book, k.cast("int").alias("pos"), F.concat(F.lit("d"), n).alias("id"))
    items = d.filter(k % 13 != 0).select(
        book, k.cast("int").alias("pos"), F.concat(F.lit("d"), n).alias("id"), F.concat(F.lit("text/"), n, F.lit(".xhtml")).alias("href"),
        F.when(k % 11 == 0, F.lit("image/png")).when(k % 2 == 0, F.lit("application/xhtml+xml")).alias("media_type"))
    marks = F.when(k % 6 == 0, F.array(F.lit(""), F.lit("#a"), F.lit("#b"), F.lit("#a"), F.lit("#p"))).when(k % 3 == 0, F.array(F.lit("")))
    entries = d.filter(k % 3 == 0).select(book, k, F.posexplode(marks).alias("i", "mark"))
    title = F.when(F.col("mark") == "#p", F.concat(F.lit("page "), n)).otherwise(F.concat(F.lit("Section "), n, F.lit("."), F.col("i").cast("string")))
    contents = entries.select("book_id", (k * 10 + F.col("i")).cast("int").alias("pos"), F.concat(F.lit("./text/"), n, F.lit(".xhtml"), F.col("mark")).alias("href"), title.alias("title"))
    return spine, items, contents


_BOOK = "source || '-' || (doc_id // 400)"
_FLOW = f"""flow AS (SELECT {_BOOK} AS book_id, doc_id, row_number() OVER (PARTITION BY {_BOOK} ORDER BY doc_id) - 1 AS pos FROM documents WHERE doc_id % 13 <> 0)"""
_SEG = f"""seg AS (SELECT *, lead(anchor) OVER (PARTITION BY doc_id ORDER BY i) AS next_anchor, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS segment FROM (
    SELECT doc_id, {_BOOK} AS book_id, 0 AS i, NULL AS anchor, 'Section ' || doc_id || '.0' AS title FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, {_BOOK}, 1, 'a', 'Section ' || doc_id || '.1' FROM documents WHERE doc_id % 6 = 0
    UNION ALL SELECT doc_id, {_BOOK}, 2, 'b', 'Section ' || doc_id || '.2' FROM documents WHERE doc_id % 6 = 0))"""
_DESC = f"""WITH {_FLOW}, {_SEG}, described AS (SELECT f.book_id, f.doc_id, f.pos, s.anchor, s.next_anchor, s.title, s.segment,
    row_number() OVER (PARTITION BY f.book_id ORDER BY f.pos, coalesce(s.segment, 0)) AS chapter_index
  FROM flow f LEFT JOIN seg s USING (doc_id) WHERE f.doc_id % 11 <> 0)"""


def _descriptors(spark, sf):
    spine, items, contents = _lists(spark, sf)
    return toc.chapter_descriptors(toc.flow_items(spine, items), contents)


@R.add("j4_spine_manifest_join", f"WITH {_FLOW} SELECT book_id, 'd' || doc_id AS id, pos::INTEGER AS pos FROM flow")
def j4(spark, sf):
    spine, items, _ = _lists(spark, sf)
    return toc.flow_items(spine, items).select("book_id", "id", "pos")


@R.add("f7_flow_chapters", f"WITH {_FLOW} SELECT book_id, 'd' || doc_id AS id FROM flow WHERE doc_id % 11 <> 0")
def f7(spark, sf):
    spine, items, _ = _lists(spark, sf)
    return toc.flow_chapters(toc.flow_items(spine, items)).select("book_id", "id")


@R.add("f8_toc_filter", f"WITH {_SEG} SELECT book_id, count(*)::BIGINT AS usable FROM seg GROUP BY book_id")
def f8(spark, sf):
    return toc.toc_segments(_lists(spark, sf)[2]).groupBy("book_id").agg(F.count(F.lit(1)).alias("usable"))


@R.add("a7_distinct_toc_targets", f"WITH {_SEG} SELECT book_id, 'text/' || doc_id || '.xhtml' AS source_href, anchor AS start_anchor, title FROM seg")
def a7(spark, sf):
    return toc.toc_segments(_lists(spark, sf)[2]).select("book_id", "source_href", "start_anchor", "title")


@R.add("j5_chapter_descriptors", f"""{_DESC} SELECT book_id, 'd' || doc_id AS source_id, coalesce(title, 'Chapter ' || (pos + 1)) AS title,
    'd' || doc_id || CASE WHEN anchor IS NOT NULL THEN ':a:' || anchor || ':' || (segment + 1) ELSE '' END AS chapter_id FROM described""")
def j5(spark, sf):
    return _descriptors(spark, sf).select("book_id", "source_id", "title", "chapter_id")


@R.add("w1_chapter_ordinal", f"{_DESC} SELECT book_id, 'd' || doc_id AS source_id, anchor AS start_anchor, chapter_index::INTEGER AS chapter_index FROM described")
def w1(spark, sf):
    return _descriptors(spark, sf).select("book_id", "source_id", "start_anchor", "chapter_index")


@R.add("w2_end_anchor", f"{_DESC} SELECT book_id, chapter_index::INTEGER AS chapter_index, anchor AS start_anchor, next_anchor AS end_anchor FROM described")
def w2(spark, sf):
    return _descriptors(spark, sf).select("book_id", "chapter_index", "start_anchor", "end_anchor")


@R.add("w7_toc_title_choice", """
  SELECT c_nationkey AS book_id, lower(c_mktsegment) || '.xhtml' AS href, title, first AS pos FROM (
    SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'Chapter ' || (c_custkey % 50) ELSE c_name || repeat('!', (c_custkey % 7)::INTEGER) END AS title,
      min(c_custkey::INTEGER) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first FROM customer)
  QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY
    CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE 16 END DESC, length(title) DESC, c_custkey) = 1""")
def w7(spark, sf):
    """Entries of several tables of contents, one title kept per target (U3)."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    title = F.when(k % 3 == 0, F.concat(F.lit("Chapter "), (k % 50).cast("string"))).otherwise(F.concat(F.col("c_name"), F.expr("repeat('!', int(c_custkey % 7))")))
    entries = c.select(F.col("c_nationkey").alias("book_id"), k.cast("int").alias("pos"), F.concat(F.lit("x/../"), F.lower("c_mktsegment"), F.lit(".xhtml")).alias("href"), title.alias("title"))
    first = entries.filter("pos % 2 = 0")
    return toc.best_toc_titles(union_all(first, entries.filter("pos % 2 = 1"))).select("book_id", "href", "title", "pos")


@R.add("j12_href_lookup", """
  SELECT page_id AS ref_id, CASE page_id % 4 WHEN 0 THEN 'p' || page_id WHEN 1 THEN 'p' || page_id WHEN 2 THEN 'p' || page_id END AS item_id FROM pages""")
def j12(spark, sf):
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    pages = table(spark, sf, "pages")
    book = (k % 5).alias("book_id")
    manifest = pages.select(book, k.alias("pos"), F.concat(F.lit("p"), n).alias("id"), F.concat(F.lit("OPS/Img/"), n, F.lit(".png")).alias("href"), F.lit("image/png").alias("media_type"))
    ref = F.when(k % 4 == 0, F.concat(F.lit("#p"), n)).when(k % 4 == 1, F.concat(F.lit("../Img/"), n, F.lit(".png"))).when(k % 4 == 2, F.concat(F.lit("../IMG/"), n, F.lit(".PNG#f"))).otherwise(F.lit("nothing"))
    refs = pages.select(book, k.alias("ref_id"), F.lit("OPS/text/a.xhtml").alias("base"), ref.alias("reference"))
    return covers.lookup_manifest(refs, manifest).select("ref_id", "item_id")


# --- stored chapters and packing --------------------------------------------------------------
def _chapters(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("book_id"), (F.col("turn") + 1).cast("int").alias("chapter_index"),
        F.concat_ws("-", "role", F.col("turn").cast("string")).alias("chapter_id"), F.col("role").alias("chapter_title"), F.repeat("text", F.lit(7)).alias("html"))


_JSON = "to_json({'chapterId': role || '-' || turn, 'chapterTitle': role, 'chapterIndex': (turn + 1)::INTEGER, 'html': repeat(text, 7)})::VARCHAR"
_PACKED = f"""WITH c AS (SELECT conv_id AS book_id, (turn + 1)::INTEGER AS chapter_index, role || '-' || turn AS chapter_id, strlen({_JSON}) + 1 AS bytes FROM conversations),
  i AS (SELECT *, count(*) FILTER (bytes > 8192) OVER (PARTITION BY book_id ORDER BY chapter_index) AS island FROM c),
  s AS (SELECT *, (row_number() OVER (PARTITION BY book_id, island ORDER BY chapter_index) - 1) // 24 AS local FROM i WHERE bytes <= 8192),
  packed AS (SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY island, local) AS batch_index FROM s)"""


def _sized(spark, sf):
    json = packing.stored_json(F.col("chapter_id"), F.col("chapter_title"), F.col("chapter_index"), F.col("html"))
    return _chapters(spark, sf).select("book_id", "chapter_id", "chapter_index", packing.stored_bytes(json).alias("json_bytes"))


@R.add("w6_batch_packing", f"{_PACKED} SELECT book_id, chapter_index, batch_index::INTEGER AS batch_index FROM packed UNION ALL SELECT book_id, chapter_index, NULL FROM i WHERE bytes > 8192")
def w6(spark, sf):
    return packing.pack_chapters(_sized(spark, sf)).select("book_id", "chapter_index", "batch_index")


@R.add("s5_chapter_objects", f"""{_PACKED}
  SELECT book_id, 'books/b-' || book_id || '/chapters/' || lpad(chapter_index::VARCHAR, 6, '0') || '-' || chapter_id || '.json' AS object_name, bytes::BIGINT AS bytes, 1 AS chapters FROM i WHERE bytes > 8192
  UNION ALL SELECT book_id, 'books/b-' || book_id || '/chapter-batches/batch-' || lpad(batch_index::VARCHAR, 6, '0') || '.json',
    (sum(bytes - 1) + count(*) - 1 + strlen('{{"batchIndex":' || batch_index || ',"chapters":[]}}') + 1)::BIGINT, count(*)::INTEGER FROM packed GROUP BY book_id, batch_index""")
def s5(spark, sf):
    prefix = target_prefix(F.concat(F.lit("b-"), F.col("book_id").cast("string"), F.lit(".epub")))
    m = packing.batch_manifest(packing.pack_chapters(_sized(spark, sf)), prefix)
    return m.select("book_id", "object_name", "bytes", F.size("chapters").alias("chapters"))


@R.add("s4_stored_chapters", """
  SELECT doc_id, doc_id::VARCHAR AS "chapterId", lang AS "chapterTitle", CASE WHEN doc_id % 3 = 0 THEN '' ELSE md5(text) END AS html FROM documents WHERE doc_id % 4 <> 0""")
def s4(spark, sf):
    k = F.col("doc_id")
    stored = F.to_json(F.struct(
        F.when(k % 4 != 0, k.cast("string")).alias("chapterId"), F.col("lang").alias("chapterTitle"), (k + 1).cast("int").alias("chapterIndex"), F.when(k % 3 != 0, F.col("text")).alias("html")))
    good, _ = parse_chapters(table(spark, sf, "documents").select("doc_id", stored.alias("value")), "dead_letter")
    return good.select("doc_id", "chapterId", "chapterTitle", F.when(F.length("html") > 0, F.md5("html")).otherwise("").alias("html"))


@R.add("s4_stored_batches", """
  SELECT conv_id, (turn + 1)::INTEGER AS "chapterIndex", role AS "chapterTitle", length(text)::INTEGER AS chars FROM conversations""")
def s4_batches(spark, sf):
    c = table(spark, sf, "conversations")
    chapter = F.struct((F.col("turn") + 1).cast("int").alias("chapterIndex"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("chapterId"), F.col("role").alias("chapterTitle"), F.col("text").alias("html"))
    # a conversation stands for one packed batch, which is bounded
    objects = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(chapter)).alias("chapters")).select(
        "conv_id", F.to_json(F.struct(F.lit(1).alias("batchIndex"), "chapters")).alias("value"))
    rows, _ = parse_batches(objects)
    return rows.select("conv_id", "chapterIndex", "chapterTitle", F.length("html").alias("chars"))


@R.add("j7_manifest_check", """
  WITH a AS (SELECT DISTINCT l_orderkey AS book_id, l_linenumber AS batch_index, 'p' || l_partkey AS chapter_id, l_suppkey::INTEGER AS chapter_index, l_quantity AS q FROM lineitem),
  s AS (SELECT book_id, batch_index, chapter_id, chapter_index FROM a WHERE q >= 3 UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, 'x', 0 FROM lineitem WHERE l_quantity = 7),
  n AS (SELECT book_id, batch_index, sum(a) AS na, sum(s) AS ns FROM (SELECT book_id, batch_index, 1 AS a, 0 AS s FROM a UNION ALL SELECT book_id, batch_index, 0, 1 FROM s) GROUP BY ALL)
  SELECT book_id, batch_index, chapter_id, chapter_index, 'missing' AS problem FROM a WHERE (book_id, batch_index, chapter_id, chapter_index) NOT IN (SELECT (book_id, batch_index, chapter_id, chapter_index) FROM s)
  UNION ALL SELECT *, 'unexpected' FROM s WHERE chapter_id = 'x'
  UNION ALL SELECT book_id, batch_index, NULL, NULL, 'count' FROM n WHERE na <> ns""")
def j7(spark, sf):
    """Both set differences and the counts of announced against stored chapters (U5)."""
    line = table(spark, sf, "lineitem")
    shape = [F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("batch_index")]
    full = line.select(*shape, F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("chapter_id"), F.col("l_suppkey").cast("int").alias("chapter_index"), "l_quantity").distinct()
    extra = line.filter("l_quantity = 7").select(*shape, F.lit("x").alias("chapter_id"), F.lit(0).alias("chapter_index")).distinct()
    stored = union_all(full.filter("l_quantity >= 3").drop("l_quantity"), extra)
    return packing.manifest_problems(full.drop("l_quantity"), stored)


# --- chunking ---------------------------------------------------------------------------------
@R.add("g1_text_splitter", f"""
  SELECT doc_id, 0::BIGINT AS broken, true AS ends, true AS dense FROM documents WHERE length({paragraphs_sql('text')}) > 0""")
def g1(spark, sf):
    """Every chunk reads back from its offsets, numbering is dense, the last one ends the text."""
    texts = table(spark, sf, "documents").select("doc_id", tidy_paragraphs(F.col("text")).alias("text"))
    chunks = split_to_rows(texts.withColumn("whole", F.col("text")))
    same = F.expr("substring(whole, source_start_char + 1, source_end_char - source_start_char) = text") & ((F.length("text") <= 1200) | ~F.contains("text", F.lit(" ")))
    return chunks.groupBy("doc_id").agg(
        F.count_if(~same).alias("broken"), F.max_by(F.endswith("whole", "text"), "chunk_index").alias("ends"),
        (F.max("chunk_index") == F.count(F.lit(1))).alias("dense"))


@R.add("g1_boundaries", r"""
  WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
  w AS (SELECT doc_id, len(list_aggregate(l[:i], 'string_agg', ' ')) AS e, len(l[i]) AS n FROM (SELECT doc_id, string_split(t, ' ') AS l, unnest(range(1, len(string_split(t, ' ')) + 1)) AS i FROM t WHERE t <> '')),
  c AS (SELECT doc_id, 1 AS i, 0 AS s, max(e) AS e FROM w WHERE e <= 300 OR e = n GROUP BY doc_id
    UNION ALL SELECT c.doc_id, any_value(c.i) + 1, c.e + 1, max(w.e) FROM c JOIN w ON w.doc_id = c.doc_id AND w.e > c.e AND (w.e - c.e - 1 <= 300 OR w.e - w.n = c.e + 1) GROUP BY c.doc_id, c.e)
  SELECT doc_id, i::INTEGER AS chunk_index, s::INTEGER AS source_start_char, e::INTEGER AS source_end_char, (e - s)::INTEGER AS char_count, 0 AS context_chars FROM c""")
def g1_boundaries(spark, sf):
    """Every boundary of a split at blanks only, without overlap."""
    text = F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "))
    chunks = split_to_rows(table(spark, sf, "documents").select("doc_id", text.alias("text")), max_chars=300, overlap=0, separators=[" "])
    return chunks.select("doc_id", "chunk_index", "source_start_char", "source_end_char", "char_count", "context_chars")


@R.add("w3_chunk_overlap", """
  SELECT l_orderkey, l_linenumber, greatest(0, coalesce(lag(l_linenumber * 10 + l_suppkey % 9 + 8) OVER w - (l_linenumber * 10 + l_suppkey % 9 - 2), 0))::INTEGER AS context_chars
  FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def w3(spark, sf):
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    start = F.col("l_linenumber") * 10 + (F.col("s") % 9).cast("int") - 2
    chunks = line.select("l_orderkey", F.col("l_linenumber").alias("chunk_index"), start.alias("source_start_char"), (start + 10).alias("source_end_char"), F.lit("t").alias("text"))
    return with_context(chunks, ["l_orderkey"]).select("l_orderkey", F.col("chunk_index").alias("l_linenumber"), "context_chars")


@R.add("f2_indexable_chunks", "SELECT conv_id, turn FROM conversations WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 40")
def f2(spark, sf):
    return indexable(table(spark, sf, "conversations")).select("conv_id", "turn")


def page_chapters(spark, sf):
    return table(spark, sf, "pages").select(
        (F.col("page_id") % 10).alias("book_id"), F.col("page_id").cast("string").alias("chapter_id"), F.col("page_id").cast("int").alias("chapter_index"),
        F.col("url").alias("chapter_title"), F.when(F.col("page_id") % 9 == 0, F.lit("<p>short</p>")).otherwise(F.col("html")).alias("html"))


_TEXT = f"CASE WHEN page_id % 9 = 0 THEN 'short' ELSE {paragraphs_sql(html_text_sql('html'))} END"


@R.add("p2_vectorize", f"SELECT page_id::VARCHAR AS chapter_id, length({_TEXT}) >= 40 AS indexed, page_id % 10 = 3 AND length({_TEXT}) >= 40 AS searchable FROM pages")
def p2(spark, sf):
    """Chapters with at least one point, and points of finished books open to search."""
    chapters = page_chapters(spark, sf)
    points, recorded, _ = vectorize(chapters, completed_books=chapters.filter("book_id = 3").select("book_id"), dim=64)
    flags = points.groupBy("chapter_id").agg(F.bool_and("is_searchable").alias("searchable"))
    return recorded.join(flags, "chapter_id", "left").select("chapter_id", (F.col("chunks_count") > 0).alias("indexed"), F.coalesce("searchable", F.lit(False)).alias("searchable"))


@R.add("p2_chunk_table", f"SELECT page_id::VARCHAR AS chapter_id, 0::BIGINT AS broken, length({_TEXT})::INTEGER AS last_end FROM pages WHERE length({_TEXT}) > 0")
def p2_chunks(spark, sf):
    chapters = page_chapters(spark, sf)
    chunks = chunk_chapters(chapters).join(chapters.select("chapter_id", html_to_text(F.col("html")).alias("whole")), "chapter_id")
    same = F.expr("substring(whole, source_start_char + 1, char_count) = text")
    return chunks.groupBy("chapter_id").agg(F.count_if(~same).alias("broken"), F.max("source_end_char").alias("last_end"))
