"""Events that need a book's row wait for it: held in a table, passed on in order, given up after some retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.session import stage_table, stages_removed, union_all
from vellum.sources.folders import exists, names_in, remove

#: The event that makes the row, and how often and after how long in event time the others are tried again.
PARENT, MAX_ATTEMPTS, RETRY_MS = "BookCreated", 10, 60_000
EVENT = "book_id long, event_id string, type string, ts timestamp, body string, attempts int"
_WAITING = f"{EVENT}, until long"
#: Folders of new books that are merged into one.
FAN = 64


def attempt_of(header: Column) -> Column:
    """Retry number of a message header: a whole number from 0, anything else counts as 0."""
    return F.coalesce(F.greatest(F.lit(0), header.try_cast("int")), F.lit(0))


class Books:
    """The books whose row exists: a folder for each micro-batch that brought some; a merged one takes the place of those before it."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN) -> None:
        self.spark, self.path, self.fan = spark, path, fan

    def _before(self, number: int) -> tuple[list[str], list[str]]:
        """Names of the folders that hold the books of the batches before one, and of those that a merged folder has replaced."""
        found = sorted((int(n.split("=")[1]), n) for n in names_in(self.spark, self.path) if exists(self.spark, f"{self.path}/{n}/_SUCCESS"))
        found = [(k, n) for k, n in found if k < number]
        base = max((k for k, n in found if n.startswith("all=")), default=-1)
        used = [n for k, n in found if k > base or (k == base and n.startswith("all="))]
        return used, [n for _, n in found if n not in used]

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema("book_id long").parquet(*[f"{self.path}/{n}" for n in names])

    def add(self, new: DataFrame, number: int) -> DataFrame | None:
        """Keep the new books of a batch; all books up to it, or None if there are none. A repeated batch replaces its own folder."""
        used, replaced = self._before(number)
        for name in replaced:
            remove(self.spark, f"{self.path}/{name}")
        if not new.isEmpty():
            merge = len(used) >= self.fan
            own = f"{'all' if merge else 'batch'}={number}"
            kept = union_all(self._read(used), new) if merge else new
            kept.distinct().write.mode("overwrite").parquet(f"{self.path}/{own}")
            used = [own] if merge else [*used, own]
        return self._read(used) if used else None


class Parked:
    """What a stream of parked events keeps between its micro-batches, as tables beside its logs.

    `waiting/batch=N` holds the events without a book after batch N, `clock` the
    watermark, `books` the books. A batch reads what the one before it left and
    writes its own, so a repeated batch replaces its own part. Once the parent
    has come, waiting events pass in order of their time, and later ones at once.
    Waiting counts as a retry for every `retry_ms` that the watermark moves on;
    behind the last one an event is given up. Going by the watermark, a replay
    gives up the same events, and an idle stream none.
    """

    def __init__(self, spark: SparkSession, folder: str, parent: str, max_attempts: int, retry_ms: int, delay: str) -> None:
        self.spark, self.folder = spark, folder
        self.parent, self.max_attempts, self.delay = parent, F.lit(max_attempts), delay
        self.retry = F.lit(retry_ms).cast("long")
        self.books = Books(spark, f"{folder}/books")

    def step(self, batch: DataFrame, number: int) -> None:
        from vellum.streaming.runners import write_batch

        seen = stage_table(batch)
        last = self._last(number)
        gone, now = self._clock(last)
        came = seen.filter("not is_clock").select("book_id", "event_id", "type", "ts", "body", F.coalesce("attempts", F.lit(0)).alias("attempts"))
        until = F.greatest(F.lit(now), F.unix_millis("ts")) + self.retry * F.greatest(F.lit(1), self.max_attempts - F.col("attempts"))
        events = came.withColumn("until", until)
        if last is not None:
            # the batch that left them has given up those whose time was over in it
            events = union_all(events, self._left(last).filter(F.col("until") > gone))
        books = self.books.add(came.filter(F.col("type") == self.parent).select("book_id"), number)
        if books is None:
            passed, rest = events.filter(F.lit(False)), events
        else:
            there = F.col("book_id").eqNullSafe(F.col("known_id"))
            known = books.select(F.col("book_id").alias("known_id"))
            # laid out by the two keys of the null-safe join: one exchange serves it and brings a book's events together.
            # Not a semi-join, which Spark moves below the layout, so that all rows are exchanged twice
            laid = events.repartition(F.coalesce("book_id", F.lit(0).cast("long")), F.isnull("book_id"))
            passed, rest = laid.join(known.distinct(), there).drop("known_id"), events.join(known, there, "left_anti")
        order = ["book_id", ~F.col("type").eqNullSafe(self.parent), "ts", "event_id"]
        write_batch(self._tried(passed.sortWithinPartitions(*order), now), f"{self.folder}/passed", number)
        write_batch(rest, f"{self.folder}/waiting", number)
        write_batch(self._tried(self._left(number).filter(F.col("until") <= now), now), f"{self.folder}/dead", number)
        behind = seen.select(F.unix_millis(F.max("clock") - F.lit(self.delay).cast("interval")).alias("behind"))
        write_batch(behind.select(F.lit(now).alias("gone"), F.greatest(F.lit(now), "behind").alias("now")), f"{self.folder}/clock", number)

    def _last(self, number: int) -> int | None:
        """The batch before this one; what the batches before that left is not needed any more."""
        done = sorted(int(n.split("=")[1]) for n in names_in(self.spark, f"{self.folder}/clock"))
        done = [k for k in done if k < number]
        for k in done[:-1]:
            remove(self.spark, f"{self.folder}/waiting/batch={k}")
            remove(self.spark, f"{self.folder}/clock/batch={k}")
        return done[-1] if done else None

    def _clock(self, last: int | None) -> tuple[int, int]:
        """The watermark in the last batch and after it, in milliseconds."""
        if last is None:
            return 0, 0
        row = self.spark.read.schema("gone long, now long").parquet(f"{self.folder}/clock/batch={last}").first()
        return row.gone, row.now

    def _left(self, number: int) -> DataFrame:
        return self.spark.read.schema(_WAITING).parquet(f"{self.folder}/waiting/batch={number}")

    def _tried(self, events: DataFrame, now: int) -> DataFrame:
        """Events with their retries up to now: those before they came here and those of their wait."""
        wait = F.greatest(F.lit(0).cast("long"), F.col("until") - F.lit(now))
        left = F.call_function("div", wait + self.retry - 1, self.retry)
        return events.withColumn("attempts", F.greatest(F.col("attempts"), self.max_attempts - left).cast("int")).drop("until")


def projected_stream(
    events: DataFrame, folder: str, available_now: bool = True, parent: str = PARENT, max_attempts: int = MAX_ATTEMPTS, retry_ms: int = RETRY_MS, delay: str = "0 seconds",
) -> StreamingQuery:
    """Keep logs of passed and dead events (EVENT) of a stream of (book_id, event_id, type, ts, body, attempts); the read model is the batch projection of the passed ones.

    `attempts` is how often the message was tried before it came here. Topics may
    start in any order: an event that comes before its book waits in a table
    under the folder. No event is dropped for coming late. The latest time is
    kept by an aggregate of the stream, so that Spark, once the watermark has
    moved and no data come, adds a micro-batch in which events are given up.
    """
    from vellum.streaming.runners import start

    rows = events.select(
        F.col("book_id").cast("long").alias("book_id"), F.col("event_id").cast("string").alias("event_id"), "type", "ts", "body", F.col("attempts").cast("int").alias("attempts"),
        F.lit(None).cast("timestamp").alias("clock"), F.lit(False).alias("is_clock"))
    latest = events.withWatermark("ts", delay).groupBy().agg(F.max("ts").alias("clock"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:6]]
    stream = union_all(rows, latest.select(*none, "clock", F.lit(True).alias("is_clock")))
    parked = Parked(events.sparkSession, folder, parent, max_attempts, retry_ms, delay)

    def step(batch: DataFrame, number: int) -> None:
        with stages_removed(batch.sparkSession):
            parked.step(batch, number)

    return start(stream, step, f"{folder}/checkpoint", available_now=available_now, mode="update")
