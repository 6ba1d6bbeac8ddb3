"""Finding the cover image of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.constants import WS
from vellum.functions.html import image_references
from vellum.functions.keys import decode_uri, normalize_href, normalize_path, resolve_href
from vellum.functions.text import strip
from vellum.operators.merges import keep_first
from vellum.session import union_all

# fixed value: names that look like a cover
_COVER_NAME = r"(?i)(^|[^a-z])(cover|coverimage|coverimg|frontcover|titlepage|title-page)([^a-z]|$)"
# fixed values: media types of documents that can hold an image
_DOCUMENT_TYPES = ["application/xhtml+xml", "text/html", "application/xml", "image/svg+xml"]


def is_image(media_type: Column) -> Column:
    return F.coalesce(media_type.startswith("image/"), F.lit(False))


def is_document(media_type: Column, href: Column) -> Column:
    by_name = href.rlike(r"(?i)\.(xhtml|html|htm|svg)$")
    return F.when(F.coalesce(F.length(media_type), F.lit(0)) == 0, by_name).otherwise(media_type.isin(*_DOCUMENT_TYPES))


def lookup_manifest(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest item of each reference: by id, by href, by href in any case.

    `refs(book_id, ref_id, base, reference)`; `manifest(book_id, pos, id, href,
    media_type)`. Adds `item_id`, `item_href`, `item_type`; null without match.
    """
    raw = strip(F.col("reference"))
    wanted = refs.withColumns(
        {
            "_id": F.regexp_replace(raw, "^#", ""),
            "_path": F.when(F.length(raw) > 0, normalize_href(resolve_href(F.col("base"), raw))),
        }
    )
    item = F.struct("id", "href", "media_type")
    by_id = manifest.groupBy("book_id", F.col("id").alias("_id")).agg(F.max_by(item, "pos").alias("_by_id"))
    by_href = manifest.groupBy("book_id", normalize_href(F.col("href")).alias("_path")).agg(
        F.max_by(item, "pos").alias("_by_href")
    )
    by_case = manifest.groupBy("book_id", F.lower("href").alias("_lower")).agg(F.min_by(item, "pos").alias("_by_case"))
    found = (
        wanted.join(by_id, ["book_id", "_id"], "left")
        .join(by_href, ["book_id", "_path"], "left")
        .withColumn("_lower", F.lower("_path"))
        .join(by_case, ["book_id", "_lower"], "left")
    )
    chosen = F.coalesce("_by_id", "_by_href", "_by_case")
    return found.select(
        *refs.columns, chosen["id"].alias("item_id"), chosen["href"].alias("item_href"), chosen["media_type"].alias("item_type")
    )


def entry_names(entries: DataFrame) -> DataFrame:
    """(book_id, exact, lower): entry number by name and by name in lower case; a later entry of the same name replaces an earlier one.

    One row per book, which is one archive of bounded size; no entry's bytes are read.
    """
    by_name = entries.groupBy("book_id", "entry").agg(F.max("entry_pos").alias("_pos"))
    by_lower = by_name.groupBy("book_id", F.lower("entry").alias("_lower")).agg(F.max("_pos").alias("_last"), F.collect_list(F.struct("entry", "_pos")).alias("_exact"))
    return by_lower.groupBy("book_id").agg(
        F.map_from_entries(F.flatten(F.collect_list("_exact"))).alias("exact"), F.map_from_entries(F.collect_list(F.struct("_lower", "_last"))).alias("lower"))


def locate_entries(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Paths with the number of their entry, `entry_pos`: exact, any case, decoded, decoded any case; null without one."""
    exact = normalize_path(F.col("path"))
    keyed = paths.withColumn("_p", exact).withColumn("_d", decode_uri(F.col("_p")))
    found = [F.try_element_at(F.col(column), key) for column, key in (("exact", F.col("_p")), ("lower", F.lower("_p")), ("exact", F.col("_d")), ("lower", F.lower("_d")))]
    return keyed.join(names.select("book_id", "exact", "lower"), "book_id", "left").select(*paths.columns, F.coalesce(*found).alias("entry_pos"))


def find_entries(paths: DataFrame, entries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Archive entry of each path: exact, any case, decoded, decoded any case.

    `paths(book_id, path, ...)`, `entries(book_id, entry, data)` with entry
    names normalised. Paths without an entry get a null `data`. Names are
    resolved first, so that bytes meet the chosen paths alone.
    """
    located = locate_entries(paths, entry_names(entries) if names is None else names)
    return located.join(entries.select("book_id", "entry_pos", "data"), ["book_id", "entry_pos"], "left").select(*paths.columns, "entry_pos", "data")


def _with_document_images(docs: DataFrame, entries: DataFrame, manifest: DataFrame, names: DataFrame) -> DataFrame:
    """First image item that each document shows: (book_id, ref_id, item_id)."""
    texts = find_entries(docs, entries, names).filter(F.col("data").isNotNull())
    refs = texts.select(
        "book_id", F.col("ref_id").alias("_doc"), F.col("path").alias("base"),
        F.posexplode(image_references(F.col("data").cast("string"))).alias("_n", "reference"),
    ).withColumn("ref_id", F.concat_ws(":", "_doc", "_n"))
    images = lookup_manifest(refs, manifest).filter(is_image(F.col("item_type")))
    return images.groupBy("book_id", F.col("_doc").alias("ref_id")).agg(F.min_by("item_id", "_n").alias("item_id"))


def cover_items(references: DataFrame, manifest: DataFrame, flow: DataFrame, entries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(book_id, item_id) of the cover by the first rule that finds an image.

    Rules in order: declared references (meta, then guide), the `cover-image`
    property, cover-like items and the first spine item (documents opened for
    their first image), a cover-like image name.
    `references(book_id, seq, base, reference)`; `names` are those of the
    entries, if they are at hand. All documents to open are opened in one pass.
    """
    names = entry_names(entries) if names is None else names
    refs = references.filter(F.length(strip(F.col("reference"))) > 0).withColumn("ref_id", F.concat(F.lit("r"), F.col("seq").cast("string")))
    resolved = lookup_manifest(refs, manifest)
    direct = resolved.filter(is_image(F.col("item_type"))).select("book_id", F.lit(1).alias("rule"), "seq", "item_id")
    no_item = F.col("item_id").isNull()
    as_document = resolved.filter(no_item | (~is_image(F.col("item_type")) & is_document(F.col("item_type"), F.col("item_href"))))
    opened = as_document.select(
        "book_id", "ref_id", "seq", F.when(no_item, resolve_href(F.col("base"), F.col("reference"))).otherwise(F.col("item_href")).alias("path")
    )
    image = is_image(F.col("media_type"))
    flagged = manifest.filter(image & F.array_contains(F.split(F.coalesce("properties", F.lit("")), WS + "+"), "cover-image")).select(
        "book_id", F.lit(2).alias("rule"), F.col("pos").alias("seq"), F.col("id").alias("item_id")
    )
    base_name = F.element_at(F.split("href", "/"), -1)
    named = manifest.filter(F.trim("id").rlike(_COVER_NAME) | F.trim(base_name).rlike(_COVER_NAME))
    first_flow = keep_first(flow.select("book_id", "id", "pos"), ["book_id"], [F.col("pos")]).select("book_id", "id")
    opening = manifest.join(first_flow, ["book_id", "id"], "left_semi").withColumn("pos", F.lit(1 << 30))
    likely = keep_first(
        union_all(named.select("book_id", "id", "href", "media_type", "pos"), opening.select("book_id", "id", "href", "media_type", "pos")), ["book_id", "id"], [F.col("pos")]
    )
    likely_images = likely.filter(image).select("book_id", F.lit(3).alias("rule"), F.col("pos").alias("seq"), F.col("id").alias("item_id"))
    documents = likely.filter(~image & is_document(F.col("media_type"), F.col("href"))).select(
        "book_id", F.concat(F.lit("m"), F.col("id")).alias("ref_id"), F.col("href").alias("path"), F.col("pos").alias("seq")
    )
    documents = union_all(opened.withColumn("rule", F.lit(1)).select("book_id", "ref_id", "path", "rule", "seq"), documents.withColumn("rule", F.lit(3)).select("book_id", "ref_id", "path", "rule", "seq"))
    shown = documents.select("book_id", "ref_id", "rule", "seq").join(
        _with_document_images(documents.select("book_id", "ref_id", "path"), entries, manifest, names), ["book_id", "ref_id"]
    ).select("book_id", "rule", "seq", "item_id")
    last = named.filter(image).select("book_id", F.lit(4).alias("rule"), F.col("pos").alias("seq"), F.col("id").alias("item_id"))

    every = direct
    for part in (shown, flagged, likely_images, last):
        every = union_all(every, part)
    return every.groupBy("book_id").agg(F.min_by("item_id", F.struct("rule", "seq")).alias("item_id"))
