"""Paths, object keys, deterministic ids and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.constants import CACHE_PREFIX, CACHE_WINDOW, IMAGE_EXTENSIONS, SNOWFLAKE_EPOCH_MS
from vellum.functions.text import let, strip


def normalize_path(c: Column) -> Column:
    """Forward slashes, `.` and `..` folded, no leading slash; empty becomes `.`."""

    def fold(done: Column, part: Column, absolute: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(part != "..", F.concat(done, F.array(part)))
            .when(can_pop, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    def fold_all(path: Column) -> Column:
        parts = F.filter(F.split(path, "/+"), lambda p: (p != "") & (p != "."))
        folded = F.aggregate(parts, F.array().cast("array<string>"), lambda d, p: fold(d, p, path.startswith("/")))
        return let(
            F.array_join(folded, "/"),
            lambda joined: F.when(F.length(joined) > 0, F.when(path.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined))
            .when(path.startswith("/"), F.lit("")).otherwise(F.lit(".")),
        )

    return let(strip(F.replace(c, F.lit("\\"), F.lit("/"))), fold_all)


def normalize_href(c: Column) -> Column:
    return normalize_path(F.substring_index(c, "#", 1))


def decode_uri(c: Column) -> Column:
    """Percent-decoded text, or null where the escapes are malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def fragment_of(href: Column) -> Column:
    after = F.when(F.contains(href, F.lit("#")), F.regexp_replace(href, "^[^#]*#", ""))
    return let(strip(after), lambda raw: F.when(F.length(raw) > 0, F.coalesce(decode_uri(raw), raw)))


def toc_target(href: Column) -> Column:
    def target(raw: Column) -> Column:
        path = normalize_path(F.substring_index(raw, "#", 1))
        return F.when(F.length(raw) == 0, F.lit("")).otherwise(F.concat_ws("#", path, fragment_of(raw)))

    return let(strip(href), target)


def directory_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def resolve_href(base_file: Column, href: Column) -> Column:
    def place(clean: Column) -> Column:
        return (
            F.when(clean.rlike(r"(?i)^[a-z][a-z\d+\-.]*:") | clean.startswith("/"), clean)
            .otherwise(F.concat(directory_of(base_file), F.lit("/"), clean))
        )

    return let(strip(href), lambda clean: F.when(F.length(clean) == 0, F.lit("")).otherwise(normalize_path(place(clean))))


def file_name(object_name: Column) -> Column:
    last = F.element_at(F.split(F.replace(object_name, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(F.length(last) > 0, last).otherwise(object_name)


def _slug(c: Column, allowed: str, size: int) -> Column:
    out = F.regexp_replace(F.lower(c), f"[^{allowed}]+", "-")
    return F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, size)


def segment_chapter_id(base: Column, anchor: Column, segment_index: Column) -> Column:
    """Id of the n-th (from 0) table-of-contents entry inside one source file."""
    number = (segment_index + 1).cast("string")
    slug = _slug(anchor, "a-z0-9_-", 48)
    numbered = F.concat(base, F.lit(":s"), number)
    return (
        F.when(F.coalesce(F.length(anchor), F.lit(0)) == 0, F.when(segment_index == 0, base).otherwise(numbered))
        .when(F.length(slug) == 0, numbered)
        .otherwise(F.concat(base, F.lit(":a:"), slug, F.lit(":"), number))
    )


def safe_part(c: Column) -> Column:
    slug = _slug(c, "a-z0-9._-", 96)
    return F.when(F.length(slug) > 0, slug).otherwise(F.lit("chapter"))


def target_prefix(source_name: Column, prefix: Column | None = None) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(source_name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    derived = F.regexp_replace(normalize_path(F.concat(F.lit("books/"), safe_part(stem))), "/+$", "")
    if prefix is None:
        return derived
    given = F.regexp_replace(normalize_path(prefix), "/+$", "")
    return F.when(F.length(strip(prefix)) > 0, given).otherwise(derived)


def chapter_object(prefix: Column, index: Column, chapter_id: Column) -> Column:
    padded = F.lpad(index.cast("string"), 6, "0")
    return F.concat(prefix, F.lit("/chapters/"), padded, F.lit("-"), safe_part(chapter_id), F.lit(".json"))


def batch_object(prefix: Column, index: Column) -> Column:
    return F.concat(prefix, F.lit("/chapter-batches/batch-"), F.lpad(index.cast("string"), 6, "0"), F.lit(".json"))


def cover_object(prefix: Column, extension: Column) -> Column:
    ext = F.lower(F.regexp_replace(extension, r"^\.+", ""))
    safe = F.when(ext.rlike("^[a-z0-9]+$"), ext).otherwise(F.lit("bin"))
    return F.concat(prefix, F.lit("/cover/original."), safe)


def point_id(book_id: Column, chapter_id: Column, chunk_index: Column) -> Column:
    """Name-based id with the version nibble 5 and the variant nibble 8..b."""
    digest = F.substring(
        F.sha1(F.concat_ws(":", book_id.cast("string"), chapter_id, chunk_index.cast("string"))), 1, 32
    )
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    variant = F.substring(F.lit("89ab"), nibble + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def snapshot_key(normalized_query: Column, window: int = CACHE_WINDOW) -> Column:
    return F.concat(F.lit(f"{CACHE_PREFIX}:w{window}:"), F.sha2(normalized_query, 256))


def snowflake(at: Column, datacenter: Column, worker: Column, sequence: Column) -> Column:
    millis = F.unix_millis(at) - F.lit(SNOWFLAKE_EPOCH_MS)
    return (
        F.shiftleft(millis, 22)
        .bitwiseOR(F.shiftleft(datacenter.cast("long").bitwiseAND(31), 17))
        .bitwiseOR(F.shiftleft(worker.cast("long").bitwiseAND(31), 12))
        .bitwiseOR(sequence.cast("long").bitwiseAND(4095))
    )


def snowflake_parts(snowflake_id: Column) -> Column:
    return F.struct(
        F.timestamp_millis(F.shiftrightunsigned(snowflake_id, 22) + F.lit(SNOWFLAKE_EPOCH_MS)).alias("at"),
        F.shiftrightunsigned(snowflake_id, 17).bitwiseAND(31).alias("datacenter"),
        F.shiftrightunsigned(snowflake_id, 12).bitwiseAND(31).alias("worker"),
        snowflake_id.bitwiseAND(4095).alias("sequence"),
    )


def parse_snowflake(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long"))


def safe_file_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]+", "_"), 1, 120)


def upload_key(user_id: Column, at_ms: Column, unique: Column, name: Column) -> Column:
    return F.concat(
        user_id.cast("string"), F.lit("/"), at_ms.cast("string"), F.lit("_"), unique, F.lit("_"),
        safe_file_name(name), F.lit(".epub"),
    )


def tolerant_timestamp(text: Column) -> Column:
    """Digits are epoch milliseconds, anything else an ISO time; else null."""
    return F.when(text.rlike(r"^\d+$"), F.timestamp_millis(text.try_cast("long"))).otherwise(
        F.try_to_timestamp(text)
    )


def media_extension(href: Column, media_type: Column) -> Column:
    base = F.element_at(F.split(href, "/"), -1)
    own = F.lower(F.regexp_extract(base, r".\.([^.]*)$", 1))
    known = F.lit(None).cast("string")
    for kind, extension in IMAGE_EXTENSIONS.items():
        known = F.when(media_type == kind, F.lit(extension)).otherwise(known)
    return F.when(own.rlike("^[a-z0-9]+$"), own).otherwise(F.coalesce(known, F.lit("bin")))


def data_url(media_type: Column, data: Column) -> Column:
    # Spark breaks base64 into lines of 76 characters; a URL has none
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.translate(F.base64(data), "\r\n", ""))
