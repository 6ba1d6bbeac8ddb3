"""Normalising, tokenising and title rules as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.constants import (
    FRONT_MATTER_WORDS,
    MIN_TERM_CHARS,
    NUMBERED_TITLE_WORDS,
    QUERY_STOP_WORDS,
    WS,
    WS_CHARS,
)

WORD = r"[\p{L}\p{N}]+"
# letters whose compatibility form is the letter itself: such text skips Python
_STABLE = r"^[\x{00}-\x{7F}À-ÖØ-öø-ÿ\x{0400}-\x{045F}]*$"


@F.pandas_udf(T.StringType())
def _compatibility_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def flat(c: Column) -> Column:
    """Every white-space run becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def normalize_search_text(c: Column, compatibility: bool = True) -> Column:
    """Lower case, compatibility form, ё written as е.

    Only rows holding characters that the compatibility form can change
    travel to Python; the others pass a null.
    """
    lowered = F.lower(c)
    if compatibility:
        odd = F.when(~lowered.rlike(_STABLE), lowered)
        lowered = F.coalesce(_compatibility_form(odd), lowered)
    return F.translate(lowered, "ё", "е")


def normalize_query(c: Column, compatibility: bool = True) -> Column:
    return flat(normalize_search_text(c, compatibility))


def words(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(WORD), F.lit(0))


def tokenize(c: Column, compatibility: bool = True) -> Column:
    return words(normalize_search_text(c, compatibility))


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def query_terms(tokens: Column) -> Column:
    """Distinct meaningful tokens in the order of first appearance."""
    kept = F.filter(
        tokens,
        lambda t: (F.length(t) >= MIN_TERM_CHARS) & ~t.isin(*QUERY_STOP_WORDS),
    )
    return F.array_distinct(kept)


def demotes_front_matter(tokens: Column, terms: Column) -> Column:
    structural = F.arrays_overlap(tokens, _literals(FRONT_MATTER_WORDS))
    return ~F.coalesce(structural, F.lit(False)) & (F.size(terms) > 0)


def opens_front_matter(title: Column, text: Column, start_char: Column) -> Column:
    """Front-matter test over a normalised title and text."""
    opens = F.ltrim(text, F.lit(WS_CHARS)).rlike("^(" + "|".join(FRONT_MATTER_WORDS) + ")")
    numbered = title.rlike("^(" + "|".join(NUMBERED_TITLE_WORDS) + r") [0-9]+$")
    return opens | (F.coalesce(start_char == 0, F.lit(False)) & numbered)


def is_front_matter(title: Column, text: Column, start_char: Column, compatibility: bool = True) -> Column:
    return opens_front_matter(
        normalize_search_text(title, compatibility), normalize_search_text(text, compatibility), start_char
    )


def normalize_suggestion(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), WS + "+", " ")


def tidy_text(c: Column) -> Column:
    """Blank runs, line ends and blank-line runs brought to one form."""
    out = F.translate(c, "\u00a0", " ")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def tidy_paragraphs(c: Column) -> Column:
    """`tidy_text`, then one line per paragraph with a blank line between."""
    paragraphs = F.transform(
        F.split(tidy_text(c), r"\n{2,}"),
        lambda p: strip(F.regexp_replace(F.regexp_replace(p, r"\n+", " "), r" {2,}", " ")),
    )
    return F.array_join(F.filter(paragraphs, lambda p: F.length(p) > 0), "\n\n")


def toc_title_score(title: Column) -> Column:
    """Quality of a table-of-contents title; negative ones are dropped."""
    t = strip(title)
    letters = F.length(F.regexp_replace(t, r"[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(t, r"[^A-Z]", ""))
    points = (
        F.when(letters > 0, 10).otherwise(0)
        + F.when(F.length(t) >= 16, 6).otherwise(0)
        + F.when(t.rlike(r"(?i)\b(chapter|part|book)\b"), 2).otherwise(0)
        - F.when(t.rlike(r"(?i)^\s*(chapter|part|book)\s+[ivxlcdm\d]+\s*$"), 3).otherwise(0)
        - F.when((letters > 0) & (capitals > letters * 0.8), 2).otherwise(0)
    ).cast("double")
    return (
        F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(float("-inf")))
        .when(t.rlike(r"(?i)^\[?\s*(pg|page)\.?\s*\d+\s*\]?$"), F.lit(-200.0))
        .when(t.rlike(r"(?i)^footnotes?:?$"), F.lit(-100.0))
        .otherwise(points)
    )


def resolve_title(base: Column, index: Column, hint: Column) -> Column:
    """Keep a telling title; replace `Chapter n` by the first heading if any."""
    b = strip(base)
    hinted = F.when(F.length(hint) > 0, F.substring(flat(hint), 1, 120))
    return F.when(~b.rlike("(?i)^chapter" + WS + r"+[0-9]+$"), b).otherwise(
        F.coalesce(hinted, F.concat(F.lit("Chapter "), index.cast("string")))
    )


def optional_text(c: Column) -> Column:
    """Blank stays an empty string, null stays null."""
    return strip(c)
