"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    def scale(v: Column) -> Column:
        # bound once: a lambda body is evaluated per element
        return let(norm(v), lambda size: F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0)))

    return let(a, scale)


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def hash_bucket(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_embedding(tokens: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for a model: unit vector of hashed token counts."""
    def count(buckets: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"),
        )

    return unit(let(F.transform(tokens, lambda t: hash_bucket(t, dim)), count))
