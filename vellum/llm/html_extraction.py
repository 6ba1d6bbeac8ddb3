"""Main text of web pages by the best-scoring run of tokens.

Words score positive and tags negative, with weights learned from labelled
pages; one linear scan finds the contiguous region with the largest sum.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled pages that weights are learned from.
FIT_PAGES = 2_000
# Elements of HTML that never hold running text, that end a block, and that have no content.
HIDDEN = "script style noscript template svg math iframe object canvas head title select option datalist audio video textarea".split()
BOILERPLATE = "nav header footer aside form button menu dialog fieldset label".split()
BLOCKS = """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Words of class and id that name what stands around an article.
AROUND = """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead
menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted reader recommended related reply replies responses share sharing
sidebar signup social sponsor sponsored subscribe toolbar widget""".split()
_HIDDEN, _BOILER, _BLOCKS, _VOID, _AROUND = map(frozenset, (HIDDEN, BOILERPLATE, BLOCKS, VOID, AROUND))
# inside an article these also name its own parts ("entry-header", "related-work"): there the scan decides; a <main> has its own header
_IN_ARTICLE = _AROUND - frozenset("header reader recommended related responses share sharing".split())
_IN_MAIN = _AROUND - {"header"}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACES = re.compile(r"\s+")
#: Starting weights, used for tags that no labelled page shows.
WORD, TAG, HEADING, AROUND, LOWEST = 2.0, -1.5, -0.25, -0.5, -6.0
#: How many times its own score the region inside the labelled element counts against the best one of the whole page.
LABEL_BONUS = 2.0


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are `open`, `close` and `text`; raw text elements are read to their end tag."""
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                yield "text", html.escape(found[0][9:].removesuffix("]]>")), ""
            continue
        name = found[2].lower()
        yield ("close" if found[1] else "open"), name, found[3] or ""
        if not found[1] and name in ("script", "style", "textarea", "title", "iframe", "noscript", "template") and not (found[3] or "").endswith("/"):
            closing = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
            yield "close", name, ""


def _named_around(attributes: str, words: frozenset[str] = _AROUND) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and not words.isdisjoint(re.split(r"[\W_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())):
            return True
        if name == "role" and value.strip().lower() in _ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Piece:
    """A token of the scan: a tag, or the text between two tags."""

    __slots__ = ("kind", "name", "text", "around", "label")

    def __init__(self, kind: str, name: str, text: str, around: bool, label: int) -> None:
        self.kind, self.name, self.text, self.around, self.label = kind, name, text, around, label


def pieces(page: str) -> list[Piece]:
    """Tokens of a page. `around`: inside an element that stands around an article; `label`: inside <article>; inside <main> where no <article> has text."""
    out: list[Piece] = []
    stack: list[tuple[str, bool]] = []
    around = articles = mains = 0

    def leave() -> None:
        nonlocal around, articles, mains
        name, was = stack.pop()
        around -= was
        articles -= name == "article"
        mains -= name == "main"

    def level() -> int:
        return 2 if articles else 1 if mains else 0

    for kind, name, rest in tokens(page):
        if kind == "text":
            out.append(Piece("text", "", name, around > 0, level()))
        elif kind == "open":
            # the header of an article is a part of it, unless it names what stands around
            own = name in _HIDDEN or name in _BOILER and not (name == "header" and level()) or _named_around(rest, _IN_ARTICLE if articles else _IN_MAIN if mains else _AROUND) and name not in ("html", "body", "main", "article")
            if name == "article" and around == 0 and rest and _named_around(rest):
                own = bool(re.search(r"comment|reply|sponsor|advert|promo", rest, re.I))
            if name == "p":  # a paragraph ends where the next begins
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _BLOCKS and stack[k][0] != "p":
                        break
                    if stack[k][0] == "p":
                        while len(stack) > k:
                            leave()
                        break
            if name not in _VOID and not rest.rstrip().endswith("/"):
                stack.append((name, own))
                around += own
                articles += name == "article"
                mains += name == "main"
            out.append(Piece("tag", name, "", around > 0 or own, level()))
        else:
            if any(n == name for n, _ in stack):
                # an end tag closes what is still open inside, but an inline one does not leave a block
                k = max(i for i, (n, _) in enumerate(stack) if n == name)
                if name in _BLOCKS or name in _HIDDEN or name in _BOILER or not any(n in _BLOCKS for n, _ in stack[k + 1 :]):
                    while len(stack) > k:
                        leave()
                else:
                    _, was = stack.pop(k)
                    around -= was
            out.append(Piece("tag", "/" + name, "", around > 0, level()))
    least = max((p.label for p in out if p.kind == "text" and not p.around and p.text.strip()), default=1) or 1
    for p in out:
        p.label = p.label >= least
    return out


class Weights:
    """Weight of a word and of each tag."""

    def __init__(self, word: float = WORD, tags: dict[str, float] | None = None) -> None:
        self.word, self.tags = word, tags or {}

    def score(self, p: Piece) -> float:
        if p.around:  # left out of the text anyway, so an advert of many words costs no more than one of few
            return AROUND
        if p.kind == "text":
            return self.word * len(p.text.split())
        weight = self.tags.get(p.name, self.tags.get("/" + p.name, TAG))
        # a heading of one word still belongs to the run it stands in front of
        return max(weight, HEADING) if re.fullmatch("/?h[1-6]", p.name) else weight


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum: one linear scan; the first and longest of equal ones; empty if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0 or k == start:
            total, start = (0.0, k) if total < 0 else (total, start)
        total += s
        if total > best or total == best and best > 0 and start == where[0]:
            best, where = total, (start, k + 1)
    return where


def _blocks(chosen: list[Piece]) -> list[str]:
    """Texts of blocks: references decoded, white space made one blank, trimmed, empty ones left out."""
    out: list[str] = []
    open_: list[str] = []

    def close() -> None:
        text = _SPACES.sub(" ", html.unescape("".join(open_))).strip()
        open_.clear()
        if text:
            out.append(text)

    for p in chosen:
        if p.kind == "text":
            if not p.around:
                open_.append(p.text)
        elif p.name.lstrip("/") in _BLOCKS:
            close()
    close()
    return out


def _whole_blocks(found: list[Piece], start: int, end: int) -> tuple[int, int]:
    """The region with the rest of its first and last block, so that a link does not cut a paragraph."""
    inline = lambda p: p.label and (p.kind == "text" or p.name.lstrip("/") not in _BLOCKS)
    while start > 0 and inline(found[start]) and inline(found[start - 1]):
        start -= 1
    while end < len(found) and inline(found[end - 1]) and inline(found[end]):
        end += 1
    return start, end


def main_blocks(page: str | None, weights: Weights) -> list[str]:
    """Blocks of the article of a page.

    The scan chooses the region on every page. Where a page says which element
    is its article (<article>, else <main>), the best region inside it counts
    LABEL_BONUS times its score; it gives way to the best region of the whole
    page only if that scores more. A region may run over an advert or notice
    in the middle: what stands around an article is left out of the text
    wherever it is.
    """
    if not page:
        return []
    found = pieces(page)
    scores = [weights.score(p) for p in found]
    start, end = best_region(scores)
    # outside the labelled element nothing scores, but tags between two labelled elements cost what they cost
    inside = [s if p.label else min(s, 0.0) for s, p in zip(scores, found)]
    first, last = best_region(inside)
    if first < last and LABEL_BONUS * sum(inside[first:last]) >= sum(scores[start:end]):
        first, last = _whole_blocks(found, first, last)
        return _blocks([p for p in found[first:last] if p.label])
    return _blocks(found[start:end])


def learn_weights(pages: DataFrame, html_column: str = "html", fit_pages: int = FIT_PAGES) -> Weights:
    """Weights from labelled pages: those that mark their article with <article> or <main>.

    About `fit_pages` different pages are read, those whose hash falls below
    their share of all, so reruns agree, no task gets more than its part of
    them, and copies of a page count once. A tag's weight is the log odds of standing inside
    the article, shifted below zero; a word's weight is the log odds of a word.
    Only counts per tag name reach the driver. Without labelled pages the
    starting weights hold.
    """
    labelled = pages.select(F.col(html_column).alias("html")).filter(F.col("html").rlike(r"(?i)<(article|main)\b"))
    sample = labelled
    if fit_pages:
        known = labelled.agg(F.approx_count_distinct(F.xxhash64("html"), 0.01)).first()[0]
        if known > fit_pages:
            sample = labelled.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(fit_pages / known * (1 << 30)))
        sample = sample.dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter = Counter()
        outside: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for p in pieces(page):
                    to = inside if p.label and not p.around else outside
                    if p.kind == "text":
                        to["#word"] += len(p.text.split())
                    elif p.name.lstrip("/").isalnum() and len(p.name) < 12:
                        to[p.name] += 1
        names = sorted(set(inside) | set(outside))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], names=["name", "inside", "outside"])

    counts = sample.mapInArrow(run, "name string, inside bigint, outside bigint").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    got = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "name").limit(500).collect()
    if not got:
        return Weights()
    odds = {r.name: math.log((r.inside + 1) / (r.outside + 1)) for r in got}
    word = max(WORD, odds.pop("#word", WORD))
    top = max(odds.values(), default=0.0)
    return Weights(word, {n: max(LOWEST, min(-0.25, (v - top) / 2 + TAG / 3)) for n, v in odds.items()})


def extract(pages: DataFrame, weights: Weights, html_column: str = "html") -> DataFrame:
    """Add text and n_chars (code points) to every row; no shuffle.

    Null and empty pages, and pages without a scoring region, give an empty
    text. Columns that carry an added name are replaced.
    """
    rows = pages.drop("text", "n_chars")
    own = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(p, shared.value)) for p in batch.column(own.index(html_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*own, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
