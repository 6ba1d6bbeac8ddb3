"""Streaming queries: idempotent projections, unpacking and vectorising."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.functions.rules import ERRORS
from vellum.operators.merges import keep_first
from vellum.schemas import ALL_PAYLOADS
from vellum.session import stage_table, stages_removed, union_all
from vellum.streaming.envelope import check_contracts, parse_envelopes, split_poison, with_payload, without_tombstones
from vellum.streaming.idlog import IdLog

Step = Callable[[DataFrame, int], None]


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """One folder per micro-batch: a repeated batch replaces its own output."""
    df.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def once(effect: Step, processed: str) -> Step:
    """Apply an effect to events not seen before, then mark them.

    The effect runs first and must replace its own earlier output for the
    same batch number. After a crash between both steps the batch comes again
    with the same number and the same unseen events, so it counts once.
    """
    def step(batch: DataFrame, number: int) -> None:
        log = IdLog(batch.sparkSession, processed)
        log.compact()
        own = stage_table(keep_first(batch, ["id"], [F.col("occurred_at")]))
        fresh = stage_table(own.join(log.known(own.select("id"), number), "id", "left_anti"))
        effect(fresh, number)
        log.add(fresh.select("id"), number)

    return step


def each_batch(effect: Step, folder: str) -> Step:
    """Apply an effect to the new, valid envelopes of a batch of messages; tables staged on the way are removed after it."""
    def step(batch: DataFrame, number: int) -> None:
        with stages_removed(batch.sparkSession):
            once(effect, f"{folder}/processed")(envelopes(batch, f"{folder}/dead", number), number)

    return step


def envelopes(messages: DataFrame, dead_letters: str, number: int) -> DataFrame:
    """Valid envelopes of a batch of messages; the others go to the dead-letter log.

    The batch is read, parsed and checked once and staged, so that what follows
    plans a scan of it and none of the rules.
    """
    messages = stage_table(messages)
    named, poison = split_poison(without_tombstones(messages), allow_key=False)
    checked = stage_table(check_contracts(parse_envelopes(named)))
    bad = checked.filter(F.size(ERRORS) > 0).select("id", "type", "payload", F.array_join(ERRORS, ",").alias("error"))
    lost = poison.select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("type"), F.col("value").cast("string").alias("payload"), "error"
    )
    write_batch(union_all(bad, lost), dead_letters, number)
    return checked.filter(F.size(ERRORS) == 0).drop(ERRORS)


def start(stream: DataFrame, step: Step, checkpoint: str, name: str | None = None, available_now: bool = True, mode: str = "append") -> StreamingQuery:
    """Offsets advance only after the step: the checkpoint is the acknowledgement."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def projection(
    stream: DataFrame, partials: Callable[[DataFrame], DataFrame], folder: str, available_now: bool = True
) -> StreamingQuery:
    """Maintain a read model as a log of mergeable per-batch states.

    A batch adds one row per key it touched and rewrites nothing; the read
    model is the merge of the log. `partials` gets new, valid envelopes.
    """
    def effect(fresh: DataFrame, number: int) -> None:
        write_batch(partials(fresh), f"{folder}/states", number)

    return start(stream, each_batch(effect, folder), f"{folder}/checkpoint", available_now=available_now)


def compact(spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], target: str) -> DataFrame:
    """Write the merged states of a projection as one table."""
    merge(spark.read.parquet(f"{folder}/states").drop("batch")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def dedup_within(stream: DataFrame, delay: str, key: str = "id", at: str = "occurred_at") -> DataFrame:
    """Bounded-state duplicates filter; `once` is the unbounded, exact one."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def unpack_stream(
    stream: DataFrame, load: Callable[[DataFrame], DataFrame], bucket: str, sink: Callable[[object, int], None], folder: str,
) -> StreamingQuery:
    """BookUploaded events: load the archives, unpack them, hand over the result.

    `load` turns (book_id, bucket, object_name) into (book_id, object_name,
    content); `sink` replaces its own output of a repeated batch number.
    """
    from vellum.plans.unpack import unpack_books

    def effect(fresh: DataFrame, number: int) -> None:
        uploads = with_payload(fresh, "BookUploaded").select(
            F.col("p.bookId").cast("long").alias("book_id"), F.col("p.bucket").alias("bucket"), F.col("p.objectName").alias("object_name")
        )
        sink(unpack_books(load(uploads), bucket), number)

    return start(stream, each_batch(effect, folder), f"{folder}/checkpoint")


def announced_chapters(fresh: DataFrame) -> DataFrame:
    """Chapters that ChapterExtracted (batch_index is null) and ChapterBatchExtracted envelopes announce; each payload is parsed once."""
    alone = F.col("type") == "ChapterExtracted"
    parsed = fresh.filter(alone | (F.col("type") == "ChapterBatchExtracted")).withColumn("p", F.from_json("payload", ALL_PAYLOADS))
    one = F.struct(F.col("p.chapterId").alias("chapterId"), F.col("p.chapterIndex").alias("chapterIndex"))
    return parsed.select("p", alone.alias("alone"), F.explode(F.when(alone, F.array(one)).otherwise(F.col("p.chapters"))).alias("c")).select(
        F.col("p.bookId").cast("long").alias("book_id"), F.col("c.chapterId").alias("chapter_id"), F.col("c.chapterIndex").cast("int").alias("chapter_index"),
        F.when(~F.col("alone"), F.col("p.batchIndex")).cast("int").alias("batch_index"), F.col("p.s3FilePath").alias("s3_file_path"), F.col("p.coverS3FilePath").alias("cover_s3_file_path"))


def compare_stored(asked: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what differs, stored chapters that may be vectorised) of announced and stored chapters.

    Both sides are counted per chapter in one aggregate and staged. A batch
    with a missing or unexpected chapter, or with another number of them, is
    left out as a whole; a chapter announced alone stands for itself.
    """
    place = ["book_id", "batch_index", "chapter_id", "chapter_index", *(["s3_file_path"] if "s3_file_path" in stored.columns else [])]
    # the object of a batch is not compared, as before: its chapters are
    keyed = lambda df: df.select(*[F.when(F.col("batch_index").isNull(), F.col(c)).alias(c) if c == "s3_file_path" else F.col(c) for c in place])
    both = union_all(keyed(asked).withColumns({"_a": F.lit(1), "_s": F.lit(0)}), keyed(stored).withColumns({"_a": F.lit(0), "_s": F.lit(1)}))
    judged = stage_table(both.groupBy(*place).agg(F.sum("_a").alias("_a"), F.sum("_s").alias("_s")))
    problem = F.when(F.col("_s") == 0, "missing").when(F.col("_a") == 0, "unexpected")
    columns = ["book_id", "batch_index", "chapter_id", "chapter_index"]
    single = judged.filter(problem.isNotNull()).select(*columns, problem.alias("problem"))
    per_batch = judged.filter("batch_index is not null").groupBy("book_id", "batch_index").agg(
        F.max(problem.isNotNull()).alias("_bad"), (F.sum("_a") != F.sum("_s")).alias("_count"))
    counts = per_batch.filter("_count").select("book_id", "batch_index", F.lit(None).cast("string").alias("chapter_id"), F.lit(None).cast("int").alias("chapter_index"), F.lit("count").alias("problem"))
    good = per_batch.filter("not _bad and not _count").select("book_id", "batch_index")
    batched = stored.filter("batch_index is not null").join(good, ["book_id", "batch_index"], "left_semi")
    own = [c for c in place if c != "batch_index"]
    alone = stored.filter("batch_index is null").join(judged.filter("batch_index is null and _a > 0 and _s > 0").select(*own), own, "left_semi")
    return union_all(single, counts), stage_table(union_all(batched.select(*stored.columns), alone.select(*stored.columns)))


def vectorize_stream(
    stream: DataFrame, load: Callable[[DataFrame], DataFrame], sink: Callable[[object, DataFrame, int], None], folder: str,
    **options,
) -> StreamingQuery:
    """ChapterExtracted and ChapterBatchExtracted events: load, check, vectorise.

    `load` turns (book_id, chapter_id, chapter_index, batch_index, s3_file_path,
    cover_s3_file_path) into the stored chapters of these objects with title
    and html. A batch whose stored chapters differ from those announced is not
    vectorised; it goes to `{folder}/broken` with what differs. So does a chapter
    announced alone whose object is missing or holds another chapter; its
    batch_index is null there. `load` hands on s3_file_path if it can, so that
    a chapter in the wrong object does not pass for another one. `sink` gets the
    result, ChapterVectorized events as outbox rows and the batch number, and
    replaces its own output of a repeated number.
    """
    from vellum.plans.vectorize import vectorize
    from vellum.sources.events import build_events, event_name_id

    def effect(fresh: DataFrame, number: int) -> None:
        asked = stage_table(announced_chapters(fresh))
        stored = stage_table(load(asked))
        broken, whole = compare_stored(asked, stored)
        write_batch(broken, f"{folder}/broken", number)
        done = vectorize(whole, **options)
        book = F.col("book_id").cast("string")
        events = build_events(
            done.recorded, "ChapterVectorized", {"bookId": book, "chapterId": F.col("chapter_id"), "chunksCount": F.col("chunks_count")},
            event_name_id(F.lit("ChapterVectorized"), book, F.col("chapter_id")))
        sink(done, events, number)

    return start(stream, each_batch(effect, folder), f"{folder}/checkpoint")


def state_machine_stream(events: DataFrame, delay: str, folder: str, available_now: bool = True) -> StreamingQuery:
    """The vectorisation state machine in event time: what it emits goes to `{folder}/emitted`, late events to `{folder}/dead`.

    `events(book_id, event_id, ts, kind, chapter_id, expected)`; events up to
    `delay` behind the latest one may come in any order.
    """
    from vellum.streaming.stateful import LATE, event_time_stream

    def step(batch: DataFrame, number: int) -> None:
        with stages_removed(batch.sparkSession):
            said = stage_table(batch)
            write_batch(said.filter(F.col("emitted") != LATE), f"{folder}/emitted", number)
            write_batch(said.filter(F.col("emitted") == LATE).select("book_id", "event_id"), f"{folder}/dead", number)

    return start(event_time_stream(events, delay), step, f"{folder}/checkpoint", available_now=available_now)
