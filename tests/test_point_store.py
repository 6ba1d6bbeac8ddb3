"""The point table as a log of changes."""

import os
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions.keys import point_id
from vellum.plans.vectorize import store_points, vectorize
from vellum.sources.folders import names_in
from vellum.sources.point_store import PointStore

DDL = "point_id string, book_id long, chapter_id string, text string, is_searchable boolean"


@pytest.fixture
def store(spark, tmp_path):
    return PointStore(spark, f"file://{tmp_path}/points", spark.createDataFrame([], DDL).schema, 8)


def rows(spark, *given):
    return spark.createDataFrame([(p, b, c, t, False) for p, b, c, t in given], DDL)


def state(store, version=None):
    return {r.point_id: (r.text, r.is_searchable) for r in store.read(version).collect()}


def test_changes_replace_and_remove(spark, store):
    assert store.version() == -1 and state(store) == {}
    store.change(points=rows(spark, ("a", 1, "x", "1"), ("b", 1, "y", "1"), ("c", 2, "x", "1"), ("d", None, None, "1")))
    store.change(points=rows(spark, ("a", 1, "x", "2")), removed=spark.createDataFrame([("c",)], "point_id string"))
    store.change(chapters=spark.createDataFrame([(1, "y"), (9, "z")], "book_id long, chapter_id string"), points=rows(spark, ("e", 1, "y", "3")))
    store.change(flags=spark.createDataFrame([(1, True), (1, True)], "book_id long, is_searchable boolean"))
    store.change(points=rows(spark, ("f", 1, "x", "5")))
    want = [
        {}, {"a": "1", "b": "1", "c": "1", "d": "1"}, {"a": "2", "b": "1", "d": "1"}, {"a": "2", "e": "3", "d": "1"}, {"a": "2", "e": "3", "d": "1"},
        {"a": "2", "e": "3", "d": "1", "f": "5"}]
    for version in range(-1, 5):
        assert {k: t for k, (t, _) in state(store, version).items()} == want[version + 1]
    # the flag holds for points that were there, not for those that came later
    assert {k for k, (_, s) in state(store).items() if s} == {"a", "e"}


def test_repeated_change_and_killed_writer(spark, store, monkeypatch):
    store.change(points=rows(spark, ("a", 1, "x", "1"), ("b", 1, "x", "1")), number=0)
    pinned = store.read()
    store.change(points=rows(spark, ("a", 1, "x", "2")), number=1)
    store.change(points=rows(spark, ("a", 1, "x", "2")), number=1)
    assert state(store) == {"a": ("2", False), "b": ("1", False)}
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.change(points=rows(spark, ("a", 1, "x", "3")), chapters=spark.createDataFrame([(1, "x")], "book_id long, chapter_id string"), number=2)
    assert state(store) == {"a": ("2", False), "b": ("1", False)} and store.version() == 1
    assert {r.text for r in pinned.collect()} == {"1"}


def test_compaction_keeps_later_marks_and_old_pins(spark, store):
    store.change(points=rows(spark, ("a", 1, "x", "1"), ("b", 1, "y", "1"), ("c", 2, "x", "1")))
    store.change(points=rows(spark, ("a", 1, "x", "2")))
    store.compact()
    assert [c.base for c in store.commits()] == [True] and state(store, 0)["a"] == ("1", False)
    store.change(chapters=spark.createDataFrame([(1, "y")], "book_id long, chapter_id string"))
    # a late repeat of a change that the base holds changes nothing
    store.change(points=rows(spark, ("a", 1, "x", "2")), number=1)
    assert state(store) == {"a": ("2", False), "c": ("1", False)}
    assert store.vacuum() >= 2
    assert state(store) == {"a": ("2", False), "c": ("1", False)} and len(names_in(spark, f"{store.path}/points")) == 2


def test_change_writes_its_rows_and_a_lookup_reads_its_buckets(spark, tmp_path):
    many = spark.range(20_000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("point_id"), (F.col("id") % 500).alias("book_id"), (F.col("id") % 40).cast("string").alias("chapter_id"),
        F.lit("t").alias("text"), F.lit(False).alias("is_searchable"))
    store = PointStore(spark, f"{tmp_path}/points", many.schema, 16)
    store.change(points=many)
    before = {f for f, _, _ in os.walk(tmp_path)}
    seen = set(store.read().inputFiles())
    # a thousand chapters change
    chapters = many.select("book_id", "chapter_id").distinct().orderBy("book_id", "chapter_id").limit(1000)
    store.change(points=many.join(chapters, ["book_id", "chapter_id"]).select(*many.columns), chapters=chapters)
    written = set(store.read().inputFiles()) - seen
    assert all("change=1" in f for f in written) and seen <= set(store.read().inputFiles()) and before <= {f for f, _, _ in os.walk(tmp_path)}
    assert spark.read.parquet(f"{tmp_path}/points/points/change=1").count() == many.join(chapters, ["book_id", "chapter_id"]).count()
    assert store.read().count() == 20_000
    books = spark.createDataFrame([(7,), (8,)], "book_id long")
    found = store.read(books=books)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 80 and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_vectorised_chapters_go_into_the_store(spark, tmp_path):
    chapters = lambda *given: spark.createDataFrame([(1, c, i, f"<p>{t}</p>") for i, (c, t) in enumerate(given, 1)], "book_id long, chapter_id string, chapter_index int, html string")
    long = "Some words of a chapter that is long enough to be kept as one chunk. "
    done = vectorize(chapters(("a", long * 40), ("b", long)))
    store = PointStore(spark, f"{tmp_path}/points", done.points.schema)
    store_points(store, done, 0)
    first = store.read().groupBy("chapter_id").count().collect()
    assert {r.chapter_id for r in first} == {"a", "b"} and dict(map(tuple, first))["a"] > 1
    # a shorter chapter leaves no old chunk behind, and one without any text loses all
    store_points(store, vectorize(chapters(("a", long), ("b", ""))), 1)
    left = store.read().select("chapter_id", "point_id").collect()
    assert [r.chapter_id for r in left] == ["a"]
    assert left[0].point_id == spark.range(1).select(point_id(F.lit(1), F.lit("a"), F.lit(1))).first()[0]
