"""Chapters to points."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.constants import CHUNK_CHARS, CHUNK_OVERLAP, MIN_CHUNK_CHARS
from vellum.functions.html import html_to_text
from vellum.functions.keys import point_id
from vellum.operators.chunking import indexable, split_to_rows
from vellum.operators.embedding import embed_by_hash
from vellum.operators.points import check_dimension, replace_chapters
from vellum.session import stage_table
from vellum.sources.point_store import PointStore

KEYS = ["book_id", "chapter_id"]


class Vectorized(NamedTuple):
    """What a run hands over."""

    points: DataFrame
    recorded: DataFrame
    errors: DataFrame


def chunk_chapters(chapters: DataFrame, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of `chapters(book_id, chapter_id, html, ...)`; html is replaced by text. Rows with `split_error` hold no chunk."""
    texts = chapters.withColumn("text", html_to_text(F.col("html"))).drop("html")
    return split_to_rows(texts, "text", max_chars, overlap)


def vectorize(
    chapters: DataFrame, existing: DataFrame | None = None, embedder: Callable[[DataFrame], DataFrame] = embed_by_hash,
    min_chars: int = MIN_CHUNK_CHARS, completed_books: DataFrame | None = None, strict_reference: bool = False, dim: int | None = None,
) -> Vectorized:
    """Point table after the change, chunks_count per chapter, and chapters that could not be split.

    The chunk table is staged, so texts are split once. Old points of the given
    chapters go first; a chapter with an error keeps its old points and is not
    recorded. Points of a book that is already complete are searchable at once;
    `strict_reference` leaves them hidden, as the original does. With `dim` a
    vector of another size stops the job.
    """
    split = stage_table(chunk_chapters(chapters))
    errors = split.filter("split_error is not null").select(*KEYS, F.col("split_error").alias("error"))
    good = chapters.join(errors.select(*KEYS), KEYS, "left_anti")
    chunks = indexable(split.filter("split_error is null").drop("split_error"), min_chars)
    points = embedder(chunks).withColumns(
        {
            "point_id": point_id(F.col("book_id"), F.col("chapter_id"), F.col("chunk_index")),
            "is_searchable": F.lit(False),
        }
    )
    if dim is not None:
        points = check_dimension(points, dim)
    if completed_books is not None and not strict_reference:
        done = completed_books.select("book_id", F.lit(True).alias("_done")).distinct()
        points = points.join(done, "book_id", "left").withColumn("is_searchable", F.coalesce("_done", F.lit(False))).drop("_done")
    counts = chunks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    recorded = good.select(*KEYS, "chapter_index").join(counts, KEYS, "left").select(
        *KEYS, "chapter_index", F.coalesce("_n", F.lit(0)).cast("int").alias("chunks_count")
    )
    # a table kept as a log (`store_points`) needs no pass over what is there
    if existing is not None:
        points = replace_chapters(existing, points.select(*existing.columns), good)
    return Vectorized(points, recorded, errors)


def store_points(store: PointStore, done: Vectorized, number: int | None = None) -> int:
    """Add a run's points to a stored point table: its chapters' older points go, others are not read."""
    return store.change(points=done.points, chapters=done.recorded, number=number)
