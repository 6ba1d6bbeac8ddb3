"""Row rules: every broken rule adds its name to an `_errors` array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.constants import (
    ALLOWED_CONTENT_TYPES, MAX_UPLOAD_BYTES, QUERY_MAX_CHARS, SUGGEST_MAX_LIMIT, SUGGEST_QUERY_MAX_CHARS,
)
from vellum.functions.text import strip

ERRORS = "_errors"


def errors_of(rules: dict[str, Column]) -> Column:
    """A rule that is false or null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*broken))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn(ERRORS, errors_of(rules))


def apply_policy(df: DataFrame, on_invalid: str = "fail") -> tuple[DataFrame, DataFrame | None]:
    """(valid rows, rejected rows or null) for the policies fail, dead_letter, drop; only `drop` loses rows, and only where it is asked for."""
    ok = F.size(ERRORS) == 0
    if on_invalid == "fail":
        message = F.concat(F.lit("invalid row: "), F.array_join(F.col(ERRORS), ","))
        checked = df.withColumn(ERRORS, F.when(ok, F.col(ERRORS)).otherwise(F.raise_error(message).cast("array<string>")))
        # the filter reads the checked column, so the check cannot be pruned away
        return checked.filter(F.size(ERRORS) == 0).drop(ERRORS), None
    valid = df.filter(ok).drop(ERRORS)
    return valid, df.filter(~ok) if on_invalid == "dead_letter" else None


def between_chars(c: Column, low: int, high: int) -> Column:
    return F.length(strip(c)).between(low, high)


def search_request_rules(query: Column, offset: Column) -> dict[str, Column]:
    return {"query": between_chars(query, 1, QUERY_MAX_CHARS), "offset": offset >= 0}


def suggest_request_rules(query: Column, limit: Column) -> dict[str, Column]:
    return {"q": between_chars(query, 1, SUGGEST_QUERY_MAX_CHARS), "limit": limit.between(1, SUGGEST_MAX_LIMIT)}


def upload_request_rules(name: Column, content_type: Column, size: Column) -> dict[str, Column]:
    return {
        "fileName": between_chars(name, 1, 255) & ~name.rlike(r"[\\/]"),
        "contentType": content_type.isin(*ALLOWED_CONTENT_TYPES),
        "contentLength": size.between(1, MAX_UPLOAD_BYTES),
    }


def book_request_rules(title: Column, authors: Column) -> dict[str, Column]:
    return {"title": F.length(title).between(1, 255), "authors": F.size(authors) >= 1}
