"""The vectorisation state machine as stateful streaming operators, in arrival order and in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "book_id long, event_id long, emitted string, done int, expected int"
#: What the event-time machine says of an event that came behind the watermark.
LATE = "Late"
_INPUT = ["event_id", "kind", "chapter_id", "expected"]


class VectorizationState(StatefulProcessor):
    """Per book: plan, status and the chapters seen; events in arrival order.

    Input columns: book_id, event_id, ts, kind (plan, chapter, failed),
    chapter_id, expected. State grows by one map entry per chapter.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", "expected int, running boolean, completed boolean, failed boolean")
        self.count = handle.getValueState("count", "done int")
        self.seen = handle.getMapState("seen", "chapter_id string", "event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        if chunks:
            # rows of a book come in chunks, and the shuffle may disturb their order: all of the micro-batch is sorted
            batch = pd.concat(chunks).sort_values(["ts", "event_id"])
            yield _table(self._advance(int(key[0]), batch[_INPUT].itertuples(index=False, name=None)))

    def _advance(self, book: int, events) -> list[tuple]:
        """Take events in order; returns what is emitted."""
        plan = self.plan.get() if self.plan.exists() else None
        done = self.count.get()[0] if self.count.exists() else 0
        known: dict[str, bool] = {}
        out: list[tuple] = []
        for event_id, kind, chapter, expected in events:
            event_id, fresh = int(event_id), False
            if kind == "plan":
                wanted = int(expected)
                if plan is None or not plan[1] or plan[0] != wanted or plan[2] or plan[3]:
                    out.append((book, event_id, "Started", done, wanted))
                plan = (wanted, True, False, False)
            elif kind == "chapter":
                if chapter not in known:
                    known[chapter] = self.seen.containsKey((chapter,))
                fresh = not known[chapter]
                if fresh:
                    known[chapter] = True
                    self.seen.updateValue((chapter,), (event_id,))
                    done += 1
                    out.append((book, event_id, "ChapterVectorized", done, None))
            else:
                out.append((book, event_id, "Failed", done, None))
                plan = plan and (plan[0], False, plan[2], True)
            if plan is None or kind == "failed":
                continue
            if done >= plan[0]:
                if not plan[2]:
                    plan = (plan[0], False, True, False)
                    out.append((book, event_id, "Completed", done, plan[0]))
            elif kind == "plan" or fresh:
                out.append((book, event_id, "Progress", done, plan[0]))
        if plan is not None:
            self.plan.update(plan)
        self.count.update((done,))
        return out

    def close(self) -> None:
        pass


class EventTimeState(VectorizationState):
    """The same machine over events in the order of their time.

    An event waits in a list until the watermark has passed its time; a timer
    at the earliest waiting time releases all that are due, sorted, so it does
    not matter in which micro-batch they came. An event whose time the
    watermark has passed already is emitted as late and changes nothing.
    Input as above, but for `at`, the event's time in microseconds, instead of ts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string, chapter_id string, expected int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        late, kept = [], []
        for chunk in rows:
            for at, event_id, kind, chapter, expected in chunk[["at", *_INPUT]].itertuples(index=False, name=None):
                if at <= passed:
                    late.append((int(key[0]), int(event_id), LATE, None, None))
                else:
                    kept.append((int(at), int(event_id), kind, chapter, None if pd.isna(expected) else int(expected)))
        if kept:
            self.waiting.appendList(kept)
            self._wake(min(k[0] for k in kept))
        if late:
            yield _table(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        events = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((e for e in events if e[0] <= passed), key=lambda e: (e[0], e[1]))
        left = [tuple(e) for e in events if e[0] > passed]
        if left:
            self.waiting.put(left)
            self._wake(min(e[0] for e in left))
        elif events:
            self.waiting.clear()
        if due:
            yield _table(self._advance(int(key[0]), ((e[1], e[2], e[3], e[4]) for e in due)))

    def _wake(self, at: int) -> None:
        """A timer at the first millisecond that is not before a time."""
        self.handle.registerTimer(-(-at // 1000))


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["book_id", "event_id", "emitted", "done", "expected"]).astype({"done": "Int32", "expected": "Int32"})


def _stateful(events: DataFrame, processor: StatefulProcessor, mode: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy("book_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode=mode)


def state_stream(events: DataFrame) -> DataFrame:
    """Emitted events of a stream of plan/chapter/failed events, keyed by book."""
    return _stateful(events, VectorizationState(), "None")


def event_time_stream(events: DataFrame, delay: str) -> DataFrame:
    """The same in event time; events may come up to `delay` behind the latest, and later ones are emitted as `LATE`.

    Spark would drop late rows before the operator sees them. It goes by the
    watermarked column, so the operator gets the time as a plain number.
    """
    timed = events.withWatermark("ts", delay)
    return _stateful(timed.select("book_id", *_INPUT, F.unix_micros("ts").alias("at")), EventTimeState(), "EventTime")
