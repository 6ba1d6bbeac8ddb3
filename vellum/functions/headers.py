"""Message headers: from an array of (key, value) to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_TYPE = "array<struct<key:string,value:binary>>"


def header(headers: Column, name: str) -> Column:
    """First non-null value of a header as text."""
    named = F.filter(headers, lambda h: (h["key"] == name) & h["value"].isNotNull())
    return F.try_element_at(named, F.lit(1))["value"].cast("string")


def header_map(headers: Column) -> Column:
    """Headers as a map; of a repeated name the first non-null value counts."""
    present = F.filter(headers, lambda h: h["value"].isNotNull())
    names = F.array_distinct(F.transform(present, lambda h: h["key"]))
    firsts = F.transform(
        names,
        lambda n: F.element_at(F.filter(present, lambda h: h["key"] == n), 1)["value"].cast("string"),
    )
    return F.map_from_arrays(names, firsts)


def build_headers(fields: dict[str, Column]) -> Column:
    return F.array(
        *[F.struct(F.lit(k).alias("key"), c.cast("string").cast("binary").alias("value")) for k, c in fields.items()]
    )


def attempt_of(value: Column) -> Column:
    """A finite non-negative number, else 0."""
    number = F.trim(value).try_cast("double")
    fits = (number >= 0) & (number < float("inf")) & ~F.isnan(number)
    return F.when(fits, number).otherwise(F.lit(0.0))
