"""Event-time state machine and events that wait for their book, over several micro-batches and restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators.lifecycle import state_machine
from vellum.streaming.parked import Books, attempt_of, projected_stream
from vellum.streaming.runners import state_machine_stream

START = datetime.datetime(2024, 1, 1)
STEPS = "book_id long, event_id long, ts timestamp, kind string, chapter_id string, expected int"
EVENTS = "book_id long, event_id string, type string, ts timestamp, body string, attempts int"


def feed(spark, folder, rows, ddl, per_trigger=1):
    """A stream of one file, so one micro-batch, for each list of rows that is not there yet."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("ignore").parquet(f"{folder}/log/{k:03}")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/log/*")


def test_shuffled_events_give_the_rows_of_the_batch_machine(spark, tmp_path):
    r = random.Random(7)
    steps = []
    for k in range(400):
        kind = r.choices(["plan", "chapter", "failed"], [1, 12, 1])[0]
        at = START + datetime.timedelta(seconds=k // 2, microseconds=r.choice([0, 500]))
        steps.append((r.randrange(3), k, at, kind, f"c{r.randrange(40)}" if kind == "chapter" else None, r.randrange(3, 20) if kind == "plan" else None))
    want = {tuple(x) for x in state_machine(spark.createDataFrame(steps, STEPS)).select("book_id", "event_id", "emitted", "done", "expected").collect()}
    # each event comes up to fifty seconds after its time
    late = sorted(steps, key=lambda e: e[2] + datetime.timedelta(seconds=r.random() * 50))
    end = [(99, -1, START + datetime.timedelta(days=9), "failed", None, None)]
    parts = [late[k : k + 80] for k in range(0, 400, 80)]
    folder = str(tmp_path)
    # stopped and started again on the way: waiting events lie in the checkpoint
    state_machine_stream(feed(spark, folder, parts[:3], STEPS), "60 seconds", folder).awaitTermination()
    early = spark.read.parquet(f"{folder}/emitted").count()
    state_machine_stream(feed(spark, folder, [*parts, end], STEPS), "60 seconds", folder).awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(f"{folder}/emitted").filter("book_id < 99").select("book_id", "event_id", "emitted", "done", "expected").collect()]
    assert 0 < early < len(got) == len(want) and set(got) == want
    assert spark.read.schema("book_id long, event_id long").parquet(f"{folder}/dead").count() == 0
    # whoever comes behind the watermark changes nothing and is told apart
    state_machine_stream(feed(spark, folder, [*parts, end, [(1, 1000, START, "plan", None, 2)]], STEPS), "60 seconds", folder).awaitTermination()
    assert [tuple(x)[:2] for x in spark.read.schema("book_id long, event_id long").parquet(f"{folder}/dead").collect()] == [(1, 1000)]
    assert spark.read.parquet(f"{folder}/emitted").filter("book_id < 99").count() == len(got)


def event(book, name, kind, minute, attempts=None):
    return (book, name, kind, START + datetime.timedelta(minutes=minute), f"body of {name}", attempts)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_topics_may_start_in_any_order(spark, tmp_path, order):
    topics = [
        [event(b, f"new-{b}", "BookCreated", b) for b in range(4)],
        [event(b, f"cover-{b}-{k}", "BookCoverExtracted", 5 + k) for b in range(6) for k in range(2)],
        [event(b, f"chapter-{b}-{k}", "ChapterExtracted", 6 + k) for b in range(5) for k in range(3)],
    ]
    folder, parts = str(tmp_path), [topics[k] for k in order]
    projected_stream(feed(spark, folder, parts[:1], EVENTS), folder).awaitTermination()
    projected_stream(feed(spark, folder, parts, EVENTS), folder).awaitTermination()
    passed = spark.read.parquet(f"{folder}/passed")
    assert sorted(r.event_id for r in passed.collect()) == sorted(e[1] for t in topics for e in t if e[0] < 4)
    assert spark.read.schema(EVENTS).parquet(f"{folder}/dead").count() == 0


def test_waiting_ends_after_the_last_retry(spark, tmp_path):
    folder = str(tmp_path)
    parts = [
        [event(1, "a", "BookCoverExtracted", 0), event(1, "b", "BookCoverExtracted", 1, 3), event(2, "c", "BookCoverExtracted", 0)],
        [event(9, "x", "BookCreated", 12)],
        [event(2, "d", "BookCreated", 13), event(9, "y", "BookCreated", 26)],
        [event(9, "w", "BookCreated", 27)],
        [event(1, "e", "BookCreated", 40), event(1, "f", "ChapterExtracted", 2)],
        [event(9, "z", "BookCreated", 60)],
    ]
    options = {"max_attempts": 4, "retry_ms": 5 * 60_000}
    projected_stream(feed(spark, folder, parts, EVENTS), folder, **options).awaitTermination()
    passed = {r.event_id: r.attempts for r in spark.read.parquet(f"{folder}/passed").collect()}
    dead = {r.event_id: r.attempts for r in spark.read.parquet(f"{folder}/dead").collect()}
    # b had one retry left, a four; c's book came in time, and f met its book
    assert dead == {"a": 4, "b": 4} and set(passed) == {"c", "d", "e", "f", "w", "x", "y", "z"} and passed["c"] == 2


def said(spark, folder, outcome):
    """(event_id, attempts) and the micro-batch of each."""
    return sorted((r.event_id, r.attempts, r.batch) for r in spark.read.parquet(f"{folder}/{outcome}").collect())


def judged(parts, max_attempts, retry_ms):
    """What passes and what is given up, by one event after the other; a last micro-batch is empty."""
    books, waiting, passed, dead, now = set(), [], [], [], 0
    for number, part in enumerate([*parts, []]):
        for book, name, kind, at, _, tried in part:
            ms = int((at - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
            waiting.append((book, name, tried or 0, max(now, ms) + retry_ms * max(1, max_attempts - (tried or 0))))
            books |= {book} if kind == "BookCreated" else set()
        row = lambda e: (e[1], max(e[2], max_attempts - -(-max(0, e[3] - now) // retry_ms)), number)  # noqa: B023, E731
        passed += [row(e) for e in waiting if e[0] in books]
        waiting = [e for e in waiting if e[0] not in books]
        dead += [row(e) for e in waiting if e[3] <= now]
        waiting = [e for e in waiting if e[3] > now]
        now = max([now, *(int((e[3] - datetime.datetime(1970, 1, 1)).total_seconds() * 1000) for e in part)])
    return sorted(passed), sorted(dead)


def test_events_are_judged_as_one_after_the_other_and_without_python(spark, tmp_path, capsys):
    r = random.Random(11)
    kinds = [*["BookCoverExtracted"] * 6, *["ChapterExtracted"] * 6, "BookCreated", None]
    parts = [[event(r.choice([None, *range(12)]), f"e{p}-{k:02}", r.choice(kinds), max(0, 6 * p + r.randrange(-30, 8)), r.choice([None, 0, 1, 3, 4, 9])) for k in range(30)] for p in range(4)]
    parts[-1].append(event(99, "end", "ChapterExtracted", 200))
    folder, options = str(tmp_path), {"max_attempts": 4, "retry_ms": 3 * 60_000}
    projected_stream(feed(spark, folder, parts[:2], EVENTS), folder, **options).awaitTermination()
    # at the end of a run, a micro-batch without data gives up events
    stopped = judged(parts[:2], 4, 3 * 60_000)
    assert (said(spark, folder, "passed"), said(spark, folder, "dead")) == stopped and stopped[0] and stopped[1]
    query = projected_stream(feed(spark, folder, parts, EVENTS), folder, **options)
    query.awaitTermination()
    whole = judged([*parts[:2], [], *parts[2:]], 4, 3 * 60_000)
    assert (said(spark, folder, "passed"), said(spark, folder, "dead")) == whole
    capsys.readouterr()
    query.explain()
    plan = capsys.readouterr().out
    # events that go through Python one by one, and a state asked for every book, cost ten times as much
    assert "Physical Plan" in plan and "Py" not in plan and "Pandas" not in plan


def test_a_repeated_micro_batch_replaces_its_own_part(spark, tmp_path):
    folder = str(tmp_path)
    parts = [[event(b, f"cover-{b}", "BookCoverExtracted", b) for b in range(4)], [event(1, "new-1", "BookCreated", 5), event(5, "late", "ChapterExtracted", 9)], [event(2, "new-2", "BookCreated", 7)]]
    options = {"max_attempts": 1, "retry_ms": 5 * 60_000}
    projected_stream(feed(spark, folder, parts, EVENTS), folder, **options).awaitTermination()
    before = [said(spark, folder, "passed"), said(spark, folder, "dead")]
    assert before[0] and before[1]
    # the last one brought data, and its end was not noted
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    projected_stream(feed(spark, folder, parts, EVENTS), folder, **options).awaitTermination()
    assert [said(spark, folder, "passed"), said(spark, folder, "dead")] == before


def test_books_stay_in_few_folders(spark, tmp_path):
    books = Books(spark, str(tmp_path / "books"), fan=2)
    for number in range(7):
        new = spark.createDataFrame([(number // 2,), (100 + number,), (None,)], "book_id long")
        for _ in range(2):
            known = sorted((r.book_id is None, r.book_id or 0) for r in books.add(new, number).distinct().collect())
        assert known == [(False, b) for b in [*range(number // 2 + 1), *range(100, 101 + number)]] + [(True, 0)]
        assert len(list((tmp_path / "books").iterdir())) <= 5
    assert books.add(new.limit(0), 7).distinct().count() == 12 and Books(spark, str(tmp_path / "none")).add(new.limit(0), 0) is None


def test_topics_are_written_by_all_cores_and_one_micro_batch_takes_each(spark, tmp_path, monkeypatch):
    from vellum.registry import events

    monkeypatch.setattr(events, "_fresh_folder", lambda spark, name: str(tmp_path))
    events.R.queries["t7_parked_stream"](spark, "/root/testdata/sf0.001")
    assert all(len(list((tmp_path / "log" / f"topic={k}").glob("*.parquet"))) > 2 for k in range(3))
    assert len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))) <= 4


def test_attempts_of_headers(spark):
    df = spark.createDataFrame([("3",), ("-1",), ("x",), (None,), ("2.5",)], "h string")
    assert [r.n for r in df.select(attempt_of(F.col("h")).alias("n")).collect()] == [3, 0, 0, 0, 0]
