"""Book archives: scan, entries and package lists as tables."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.keys import normalize_path, resolve_href, toc_target
from vellum.functions.text import flat, strip

# fixed value: where every archive names its package file
CONTAINER = "META-INF/container.xml"

#: Bytes of unpacked rows that leave a task at once, and what a row counts for besides its data.
OUTPUT_BYTES, ROW_BYTES = 2 * 1024 * 1024, 200

ARCHIVE_ROWS = (
    "book_id {book}, kind string, pos int, id string, href string, media_type string, properties string, "
    "base string, text string, data binary"
)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every .epub object under a folder."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true")
        .load(path).select("path", "length", "content")
    )


def _root(data: bytes):
    """Element tree without name-space marks; undeclared prefixes are tolerated."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", data.decode("utf-8-sig", "replace"), count=1)
    text = re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)", "&amp;", re.sub(r"<\?xml[^>]*\?>", "", text, count=1))
    text = re.sub(r"""\sxmlns(:[\w.-]+)?\s*=\s*("[^"]*"|'[^']*')""", "", text)
    return ElementTree.fromstring(re.sub(r"(</?|\s)[A-Za-z][\w.-]*:(?=[A-Za-z])(?=[^<>]*>)", r"\1", text).encode())


class _NavLinks(HTMLParser):
    """Links of the first toc nav, else of the first nav."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.navs: list[tuple[bool, list[list[str]]]] = []
        self.open: list[int] = []
        self.link = False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "nav":
            is_toc = named.get("epub:type") == "toc" or named.get("role") == "doc-toc"
            self.navs.append((is_toc, []))
            self.open.append(len(self.navs) - 1)
        elif tag == "a" and self.open:
            self.link = "href" in named
            if self.link:
                for at in self.open:
                    self.navs[at][1].append([named["href"] or "", ""])

    def handle_endtag(self, tag):
        if tag == "nav" and self.open:
            self.open.pop()
        elif tag == "a":
            self.link = False

    def handle_data(self, data):
        if self.link:
            for at in self.open:
                self.navs[at][1][-1][1] += data

    def links(self) -> list[list[str]]:
        chosen = [found for is_toc, found in self.navs if is_toc] or [found for _, found in self.navs]
        return chosen[0] if chosen else []


def _find(names: dict[str, str], path: str) -> str | None:
    """Entry name for a path: exact, any case, decoded, decoded any case."""
    lower = {n.lower(): n for n in names}
    clean = re.sub("^/+", "", path.replace("\\", "/").strip())
    for found in (names.get(clean), lower.get(clean.lower()), names.get(unquote(clean)), lower.get(unquote(clean).lower())):
        if found is not None:
            return found
    return None


def _package_rows(book, content: bytes):
    """Rows of one archive: entries, title, manifest, spine, toc, cover references."""
    def row(kind, pos=0, id=None, href=None, media_type=None, properties=None, base=None, text=None, data=None):
        return (book, kind, pos, id, href, media_type, properties, base, text, data)

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            files = [i for i in archive.infolist() if not i.is_dir()]
            names = {re.sub("^/+", "", i.filename.replace("\\", "/")): i.filename for i in files}
            for at, info in enumerate(files):
                try:
                    yield row("entry", at, href=info.filename, data=archive.read(info))
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as error:
                    # a broken entry is missing for what refers to it; the rest of the book stays
                    yield row("broken", at, href=info.filename, text=f"{type(error).__name__}: {error}")
            container = _find(names, CONTAINER)
            root_file = next(e.get("full-path") for e in _root(archive.read(container)).iter() if (e.get("full-path") or "").strip())
            package = _root(archive.read(_find(names, root_file)))
            base = root_file
            yield row("package", href=base)
            metadata, manifest, spine, guide = (package.find(t) for t in ("metadata", "manifest", "spine", "guide"))
            for kind, tag in (("title", "title"), ("creator", "creator")):
                found = metadata.find(tag) if metadata is not None else None
                if found is not None:
                    yield row(kind, text="".join(found.itertext()))
            items: dict[str, tuple[str, str, str]] = {}
            for at, item in enumerate(manifest.iter("item") if manifest is not None else []):
                id, href = (item.get("id") or "").strip(), (item.get("href") or "").strip()
                if id and href:
                    items[id] = (href, item.get("media-type") or item.get("mediaType"), item.get("properties"))
                    yield row("manifest", at, id, href, items[id][1], items[id][2], base)
            for at, ref in enumerate(spine.iter("itemref") if spine is not None else []):
                if (ref.get("idref") or "").strip():
                    yield row("spine", at, ref.get("idref").strip())
            metas = metadata.iter("meta") if metadata is not None else []
            named = [m.get("content") for m in metas if (m.get("name") or "").strip().lower() == "cover" and (m.get("content") or "").strip()]
            guides = [
                g.get("href") for g in (guide.iter() if guide is not None else [])
                if (g.get("href") or "").strip() and re.search("cover|titlepage|title-page", (g.get("type") or "").lower())
            ]
            for at, reference in enumerate(named[:1] + list(dict.fromkeys(guides))):
                yield row("cover", at, href=reference, base=base)
            # table-of-contents files are named relative to the package file
            folder = base.rsplit("/", 1)[0] + "/" if "/" in base else ""
            toc_id = (spine.get("toc") or "").strip() if spine is not None else ""
            number = 0
            if toc_id in items:
                ncx = folder + items[toc_id][0]
                for point in _root(archive.read(_find(names, ncx))).iter("navPoint"):
                    label, target = point.find("navLabel/text"), point.find(".//content")
                    if label is not None and target is not None and target.get("src"):
                        yield row("toc", number, href=target.get("src"), base=ncx, text="".join(label.itertext()))
                        number += 1
            for href, _, properties in items.values():
                if "nav" in (properties or "").split():
                    parser = _NavLinks()
                    parser.feed(archive.read(_find(names, folder + href)).decode("utf-8", "replace"))
                    for target, title in parser.links():
                        yield row("toc", number, href=target, base=folder + href, text=title)
                        number += 1
    except Exception as error:  # one bad archive must not stop the others
        yield row("error", text=f"{type(error).__name__}: {error}")


def parse_archives(archives: DataFrame) -> DataFrame:
    """Long table of everything in each archive of (book_id, content).

    Row-local: an archive is opened once, in the task that read it.
    """
    schema = ARCHIVE_ROWS.format(book=archives.schema["book_id"].dataType.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("book_id").type, pa.string(), pa.int32(), *[pa.string()] * 6, pa.binary()]
            waiting, size = [], 0
            for at in range(batch.num_rows):
                rows = list(_package_rows(batch.column("book_id")[at].as_py(), batch.column("content")[at].as_py()))
                if rows[-1][1] == "error":
                    rows = rows[-1:]  # a book is unpacked as a whole or not at all
                waiting += rows
                size += sum(len(r[-1] or b"") + ROW_BYTES for r in rows)
                # books leave in small tables, so a task never holds what a batch of archives unpacks to
                if size >= OUTPUT_BYTES or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), kinds)], names)
                    waiting, size = [], 0

    return archives.select("book_id", "content").mapInArrow(run, schema)


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") == "entry").select(
        "book_id", F.col("pos").alias("entry_pos"), normalize_path(F.col("href")).alias("entry"), "data"
    )


def manifest(parsed: DataFrame) -> DataFrame:
    """Package items; a repeated id keeps its place and takes the last values."""
    rows = parsed.filter(F.col("kind") == "manifest").select(
        "book_id", "id", "pos", resolve_href(F.col("base"), F.col("href")).alias("href"),
        strip(F.col("media_type")).alias("media_type"), strip(F.col("properties")).alias("properties"),
    )
    last = F.max_by(F.struct("href", "media_type", "properties"), "pos").alias("_last")
    return rows.groupBy("book_id", "id").agg(F.min("pos").alias("pos"), last).select("book_id", "id", "pos", "_last.*")


def spine(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") == "spine").select("book_id", "pos", "id")


def toc(parsed: DataFrame) -> DataFrame:
    """Raw entries of all tables of contents in source order."""
    return parsed.filter(F.col("kind") == "toc").select(
        "book_id", "pos", toc_target(resolve_href(F.col("base"), F.col("href"))).alias("href"),
        flat(F.col("text")).alias("title"),
    )


def cover_references(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") == "cover").select(
        "book_id", F.col("pos").alias("seq"), "base", F.col("href").alias("reference")
    )


def book_metadata(parsed: DataFrame) -> DataFrame:
    """(book_id, title, creator) with blanks as null."""
    text = flat(F.col("text"))
    filled = F.when(F.length(text) > 0, text)
    return parsed.filter(F.col("kind").isin("title", "creator", "package")).groupBy("book_id").agg(
        F.max(F.when(F.col("kind") == "title", filled)).alias("title"),
        F.max(F.when(F.col("kind") == "creator", filled)).alias("creator"),
    )


def failures(parsed: DataFrame) -> DataFrame:
    """Books that could not be read as a whole, and single entries that are broken."""
    text = F.when(F.col("kind") == "broken", F.concat(F.lit("Broken entry "), F.col("href"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return parsed.filter(F.col("kind").isin("error", "broken")).select("book_id", text.alias("error"))
