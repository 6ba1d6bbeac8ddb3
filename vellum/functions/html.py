"""Markup to text, anchors, headings and image references, all inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.constants import BLOCK_TAGS, NOISE_CONTAINERS, NOISE_VOID
from vellum.functions.text import flat, let, strip, tidy_paragraphs, tidy_text

# the entities nearly all markup uses; the rest goes through the full table
_COMMON = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©",
           "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…"}
_NUMERIC = r"&#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"
_NAMED = r"&([A-Za-z][A-Za-z0-9]*);"


def _splice(text: Column, pattern: str, decode) -> Column:
    """Replace each match by decode(group 1); pieces and matches alternate."""
    pieces = F.split(text, pattern, -1)
    codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    tail = F.transform(codes, decode)
    zipped = F.zip_with(pieces, tail, lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
    return F.array_join(zipped, "")


def _code_point(code: Column) -> Column:
    hexed = F.when(
        code.rlike("^[xX]"), F.substring(code, 2, 8)
    ).otherwise(F.hex(code.cast("long")))
    value = F.conv(hexed, 16, 10).cast("long")
    valid = (value > 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    raw = F.unhex(F.lpad(hexed, 8, "0"))
    return F.when(valid, F.decode(raw, "UTF-32")).otherwise(F.lit("�"))


def _entity_table() -> Column:
    table = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def decode_entities(c: Column) -> Column:
    out = c
    for name, value in _COMMON.items():
        out = F.replace(out, F.lit(name), F.lit(value))

    def named(text: Column) -> Column:
        spelled = _splice(
            text, _NAMED,
            lambda n: F.coalesce(F.try_element_at(_entity_table(), n), F.concat(F.lit("&"), n, F.lit(";"))),
        )
        rare = text.rlike(r"&(?!amp;)[A-Za-z][A-Za-z0-9]*;")
        return F.when(rare, spelled).otherwise(F.replace(text, F.lit("&amp;"), F.lit("&")))

    numbered = let(out, lambda t: F.when(t.rlike(_NUMERIC), _splice(t, _NUMERIC, _code_point)).otherwise(t))
    return let(numbered, named)


def break_lines(html: Column) -> Column:
    """Line breaks for <br> and after the end of every block element."""
    out = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(out, rf"(?i)(</(?:{BLOCK_TAGS})>)", "$1\n")


def body_of(html: Column) -> Column:
    """Inner markup of the body; without one, everything but the head."""
    inner = r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)"
    head = r"(?is)<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>|<!doctype[^>]*>|<\?xml[^>]*>|</?html\b[^>]*>"
    return let(
        html,
        lambda h: F.when(h.rlike(r"(?i)<body\b"), F.regexp_extract(h, inner, 1)).otherwise(F.regexp_replace(h, head, "")),
    )


def drop_noise(html: Column) -> Column:
    """Comments, scripts, media and images go; links keep their content."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, rf"(?is)<({'|'.join(NOISE_CONTAINERS)})\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(NOISE_VOID + NOISE_CONTAINERS)})\b[^>]*>", "")
    return F.regexp_replace(out, r"(?i)</?a(?:\s[^>]*)?>", "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"</?[A-Za-z!?][^>]*>", "")


def raw_text(html: Column) -> Column:
    return decode_entities(strip_tags(drop_noise(body_of(break_lines(html)))))


def html_to_text(html: Column) -> Column:
    """Plain text of a chapter for chunking: one line per paragraph."""
    return tidy_paragraphs(raw_text(html))


def chapter_html(html: Column) -> Column:
    return strip(drop_noise(body_of(break_lines(html))))


def chapter_plain_text(html: Column) -> Column:
    return tidy_text(raw_text(html))


def title_hint(html: Column) -> Column:
    """Text of the first heading, or null."""
    heading = F.regexp_extract(
        drop_noise(body_of(break_lines(html))), r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", 2
    )
    text = flat(decode_entities(strip_tags(heading)))
    return F.when(F.length(text) > 0, text)


def _anchor_position(html: Column, anchor: Column) -> Column:
    """0-based start of the tag carrying the anchor, or null."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(anchor, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    by_id = F.regexp_instr(
        html, F.concat(F.lit(r"""(?i)<[^>]+\bid\s*=\s*["']"""), quoted, F.lit(r"""["'][^>]*>"""))
    )
    by_name = F.regexp_instr(
        html, F.concat(F.lit(r"""(?i)<a[^>]+\bname\s*=\s*["']"""), quoted, F.lit(r"""["'][^>]*>"""))
    )
    # regexp_instr gives 0 where nothing matches
    return F.coalesce(F.nullif(by_id, F.lit(0)), F.nullif(by_name, F.lit(0))) - 1


def slice_by_anchors(html: Column, start: Column, end: Column) -> Column:
    """The part of a file between two anchors; the whole file if that is empty."""
    start = F.when(F.length(start) > 0, start)
    end = F.when(F.length(end) > 0, end)

    def cut(file: Column, first: Column, found: Column) -> Column:
        last = F.when(found > first, found).otherwise(F.length(file))
        return strip(F.substring(file, first + 1, last - first))

    def wrap(file: Column, part: Column) -> Column:
        return (
            F.when(F.length(part) == 0, file)
            .when(F.contains(part, F.lit("<html")), part)
            .otherwise(F.concat(F.lit("<!doctype html><html><body>"), part, F.lit("</body></html>")))
        )

    def between(file: Column) -> Column:
        ends = F.struct(
            F.coalesce(_anchor_position(file, start), F.lit(0)).alias("first"), _anchor_position(file, end).alias("found")
        )
        return let(let(ends, lambda e: cut(file, e["first"], e["found"])), lambda part: wrap(file, part))

    return F.when(start.isNull() & end.isNull(), html).otherwise(let(html, between))


def css_urls(c: Column) -> Column:
    quoted = F.regexp_extract_all(c, F.lit(r"""(?i)url\((?:'([^']*)'|"([^"]*)"|([^'")]*))\)"""), F.lit(0))
    return F.transform(
        quoted, lambda u: strip(F.regexp_replace(u, r"""(?i)^url\(['"]?|['"]?\)$""", ""))
    )


def image_references(html: Column) -> Column:
    """Distinct image targets of a document in the order of their kinds; attributes may stand without quotes, references are decoded."""
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|[^\s"'>]+)"""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:img|image|object)\b[^>]*>"), F.lit(0))

    def attribute(tag: Column, name: str) -> Column:
        found = F.regexp_extract(tag, rf"(?i)[\s\"']{name}{value}", 0)
        return F.when(
            F.length(found) > 0, decode_entities(F.regexp_replace(found, r"""(?i)^[^=]*=\s*["']?|["']$""", ""))
        )

    def target(tag: Column) -> Column:
        kind = F.lower(F.regexp_extract(tag, r"(?i)^<(img|image|object)\b", 1))
        any_of = F.coalesce(
            attribute(tag, "src"), attribute(tag, "href"), attribute(tag, "xlink:href"), attribute(tag, "data")
        )
        carries = (
            F.when(kind == "img", attribute(tag, "src").isNotNull())
            .when(kind == "image", attribute(tag, "href").isNotNull() | attribute(tag, "xlink:href").isNotNull())
            .otherwise(attribute(tag, "data").isNotNull())
        )
        return F.when(carries, any_of)

    styles = F.transform(
        F.regexp_extract_all(html, F.lit(rf"(?i)\sstyle{value}"), F.lit(0)), lambda s: s
    )
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), F.lit(1))
    found = F.concat(
        F.transform(tags, target),
        css_urls(F.array_join(styles, " ")),
        css_urls(F.array_join(blocks, " ")),
    )
    tidy = F.transform(F.filter(found, lambda v: v.isNotNull()), lambda v: strip(v))
    return F.array_distinct(F.filter(tidy, lambda v: F.length(v) > 0))


def cover_figure(data_url: Column) -> Column:
    return F.concat(
        F.lit('<figure><img src="'),
        data_url,
        F.lit('" alt="Book cover" loading="eager" decoding="async"/></figure>'),
    )
