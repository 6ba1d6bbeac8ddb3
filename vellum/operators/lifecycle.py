"""Vectorisation progress: projections and the state machine over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.merges import keep_first
from vellum.operators.ordered import running_totals
from vellum.session import union_all


def chapters_done(vectorized: DataFrame) -> DataFrame:
    """Distinct vectorised chapters per book."""
    return vectorized.groupBy("book_id").agg(F.countDistinct("chapter_id").alias("done"))


def completion(expected: DataFrame, vectorized: DataFrame) -> DataFrame:
    """(book_id, expected, done, completed) per planned book."""
    done = F.coalesce("done", F.lit(0))
    return expected.join(chapters_done(vectorized), "book_id", "left").select(
        "book_id", "expected", done.alias("done"), (done >= F.col("expected")).alias("completed")
    )


def first_seen_chapters(events: DataFrame) -> DataFrame:
    """The first event of each (book_id, chapter_id)."""
    return keep_first(events, ["book_id", "chapter_id"], [F.col("ts"), F.col("event_id")])


def running_done(events: DataFrame) -> DataFrame:
    """Done-count carried on each first-seen chapter event."""
    return running_totals(first_seen_chapters(events), ["book_id"], ["ts", "event_id"], {"done": F.lit(1)})


def projection_partials(events: DataFrame) -> DataFrame:
    """Mergeable state per book of lifecycle events.

    `events(book_id, event_id, ts, type, expected, reason)`, type one of
    Started, Progress, Completed, Failed. Every column is a min_by/max_by, so
    partial states of different batches merge to the same result in any order.
    """
    at = F.struct("ts", "event_id")
    kind = F.col("type")
    return events.groupBy("book_id").agg(
        F.max(F.struct("ts", "event_id", "type", "reason")).alias("last"),
        F.max(F.when(kind != "Failed", F.struct("ts", "event_id", "expected"))).alias("planned"),
        F.max(F.when(kind == "Started", F.col("ts"))).alias("latest_start"),
        F.min(at).alias("first"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("book_id").agg(
        F.max("last").alias("last"), F.max("planned").alias("planned"),
        F.max("latest_start").alias("latest_start"), F.min("first").alias("first"),
    )


def project(partials: DataFrame) -> DataFrame:
    """One read-model row per book."""
    kind = F.col("last.type")
    return partials.select(
        "book_id",
        F.when(kind == "Completed", "COMPLETED").when(kind == "Failed", "FAILED").otherwise("IN_PROGRESS").alias("status"),
        F.coalesce("planned.expected", F.lit(0)).cast("int").alias("expected_chapters_count"),
        F.coalesce("latest_start", "first.ts").alias("started_at"),
        F.when(kind == "Completed", F.col("last.ts")).alias("completed_at"),
        F.when(kind == "Failed", F.col("last.reason")).alias("last_error"),
    )


def state_machine(events: DataFrame) -> DataFrame:
    """Events the worker emits: (book_id, event_id, ts, emitted, done, expected).

    `events(book_id, event_id, ts, kind, chapter_id, expected)`, kind one of
    plan, chapter, failed. A plan opens an epoch; inside an epoch the first
    step with done >= expected completes the book, once. Running counts are
    spread over tasks and everything per epoch is an aggregate, so a book may
    hold any share of the events.
    """
    at = ["ts", "event_id"]
    chapters = events.filter(F.col("kind") == "chapter")
    fresh = first_seen_chapters(chapters).select("event_id", F.lit(1).alias("_new"))
    marked = events.join(fresh, "event_id", "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    steps = running_totals(
        marked, ["book_id"], at,
        {"epoch": F.when(F.col("kind") == "plan", 1).otherwise(0), "done": F.col("_new")},
    )
    plans = steps.filter(F.col("kind") == "plan").select("book_id", "epoch", F.col("expected").alias("planned"))
    acting = steps.drop("expected").join(plans, ["book_id", "epoch"])
    reached = (F.col("kind") != "failed") & (F.col("done") >= F.col("planned"))
    epochs = acting.groupBy("book_id", "epoch").agg(
        F.min("planned").alias("planned"),
        F.min(F.when(reached, F.struct(*at))).alias("_completing"),
        F.bool_or(F.col("kind") == "failed").alias("_failed"),
    )
    # an unchanged plan of a running book says nothing new
    before = epochs.select(
        "book_id", (F.col("epoch") + 1).alias("epoch"), F.col("planned").alias("_was"),
        (F.col("_completing").isNotNull() | F.col("_failed")).alias("_ended"),
    )
    known = epochs.join(before, ["book_id", "epoch"], "left").select(
        "book_id", "epoch", "_completing",
        (F.col("_was").isNull() | F.col("_ended") | (F.col("_was") != F.col("planned"))).alias("_announce"),
    )
    full = acting.join(known, ["book_id", "epoch"])
    emits_progress = (F.col("kind") == "plan") | (F.col("_new") == 1)
    open_still = F.col("_completing").isNull() | (F.struct(*at) < F.col("_completing"))
    said: list[Column] = [
        F.when((F.col("kind") == "plan") & F.col("_announce"), "Started"),
        F.when(F.col("_completing") == F.struct(*at), "Completed"),
        F.when((F.col("kind") != "failed") & emits_progress & open_still, "Progress"),
    ]
    lifecycle = full.select(
        "book_id", "event_id", "ts", F.explode(F.array_compact(F.array(*said))).alias("emitted"), "done", "planned"
    ).withColumnRenamed("planned", "expected")
    # these two are announced with or without a plan
    always = F.when(F.col("_new") == 1, "ChapterVectorized").when(F.col("kind") == "failed", "Failed")
    others = steps.withColumn("emitted", always).filter(F.col("emitted").isNotNull()).select(
        "book_id", "event_id", "ts", "emitted", "done", F.lit(None).cast(lifecycle.schema["expected"].dataType).alias("expected")
    )
    return union_all(lifecycle, others)


def read_model(created: DataFrame, covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search read model and the cover events of books nobody created.

    Latest BookCreated per book decides the metadata, latest
    BookCoverExtracted the cover.
    """
    order = [F.col("ts"), F.col("event_id")]
    from vellum.operators.merges import keep_last

    books = keep_last(created, ["book_id"], order)
    latest = keep_last(covers, ["book_id"], order).select("book_id", F.col("s3_file_path").alias("_cover"))
    known = books.join(latest, "book_id", "left").withColumn(
        "cover_object_key", F.coalesce("_cover", "cover_object_key")
    ).select("book_id", "title", "description", "authors", "cover_object_key", "created_at")
    orphans = covers.join(created.select("book_id").distinct(), "book_id", "left_anti")
    return known, orphans


def chapter_rows(extracted: DataFrame) -> DataFrame:
    """Chapter projection: latest values per chapter, html of its first event.

    `extracted(book_id, external_chapter_id, chapter_index, title, html,
    bucket, object_key, ts, event_id)`.
    """
    at = F.struct("ts", "event_id")
    rest = F.struct("chapter_index", "title", "bucket", "object_key")
    return extracted.groupBy("book_id", "external_chapter_id").agg(
        F.max_by(rest, at).alias("_now"), F.min_by("html", at).alias("html"), F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    ).select("book_id", "external_chapter_id", "_now.*", "html", "created_at", "updated_at")
