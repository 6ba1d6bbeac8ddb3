"""Maintenance of the point table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from vellum.session import union_all


def upsert_points(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming points replace those of the same id."""
    return union_all(incoming, existing.join(incoming.select("point_id"), "point_id", "left_anti"))


def delete_chapters(existing: DataFrame, chapters: DataFrame) -> DataFrame:
    """Drop every point of the given (book_id, chapter_id) pairs."""
    keys = ["book_id", "chapter_id"]
    return existing.join(chapters.select(*keys), keys, "left_anti")


def set_searchable(existing: DataFrame, flags: DataFrame) -> DataFrame:
    """Set the flag of all points of the listed books; others keep theirs."""
    wanted = flags.select("book_id", F.col("is_searchable").alias("_flag"))
    return existing.join(wanted, "book_id", "left").withColumn(
        "is_searchable", F.coalesce("_flag", "is_searchable")
    ).select(*existing.columns)


def replace_chapters(existing: DataFrame, incoming: DataFrame, chapters: DataFrame) -> DataFrame:
    """Re-index whole chapters: their old points go, also where none come back."""
    return upsert_points(delete_chapters(existing, chapters), incoming)


def check_dimension(points: DataFrame, dim: int) -> DataFrame:
    """Fail on any vector of another size, as the collection would."""
    message = F.concat(F.lit(f"vector size is not {dim}: "), F.size("dense").cast("string"))
    checked = F.when(F.col("dense").isNull() | (F.size("dense") == dim), F.col("dense"))
    return points.withColumn("dense", F.coalesce(checked, F.when(F.size("dense") != dim, F.raise_error(message).cast("array<float>"))))
