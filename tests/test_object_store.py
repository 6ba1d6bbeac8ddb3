"""Versioned objects and covers."""

import pytest

from vellum.sources.object_store import cover_store, object_store

DDL = "book_id long, object_name string, value string"


def make(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def held(store, version=None, books=None):
    return {(r.book_id, r.object_name): r.value for r in store.read(version, books).collect()}


def test_objects_of_other_books_stay_unread(spark, tmp_path):
    store = object_store(spark, f"file://{tmp_path}/objects")
    assert held(store) == {}
    store.write(make(spark, *[(b, f"{b}/1", "old") for b in range(50)]))
    before = set(store.read().inputFiles())
    store.write(make(spark, (7, "7/1", "new"), (7, "7/2", "more"), (99, "99/1", "x")))
    got = held(store)
    assert len(got) == 52 and got[7, "7/1"] == "new" and got[8, "8/1"] == "old"
    # the older files are as they were, and the older version still shows
    assert before < set(store.read().inputFiles()) and held(store, 0)[7, "7/1"] == "old"
    assert held(store, None, spark.createDataFrame([(7,), (50,)], "book_id long")) == {(7, "7/1"): "new", (7, "7/2"): "more"}


def test_killed_and_repeated_writes(spark, tmp_path, monkeypatch):
    store = object_store(spark, f"{tmp_path}/objects")
    store.write(make(spark, (1, "a", "1")), 0)
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.write(make(spark, (1, "a", "2"), (2, "b", "2")), 1)
    assert held(store) == {(1, "a"): "1"}
    store.write(make(spark, (1, "a", "2"), (2, "b", "2")), 1)
    store.write(make(spark, (1, "a", "3")), 1)
    assert held(store) == {(1, "a"): "3"}
    store.compact()
    store.write(make(spark, (2, "b", "4")))
    assert held(store) == {(1, "a"): "3", (2, "b"): "4"} and store.vacuum() >= 3
    assert held(store) == {(1, "a"): "3", (2, "b"): "4"}


def test_a_book_has_one_cover(spark, tmp_path):
    covers = spark.createDataFrame([(1, "k", "image/png", b"a"), (2, "k", "image/png", b"b")], "book_id long, object_key string, media_type string, bytes binary")
    store = cover_store(spark, f"{tmp_path}/covers")
    store.write(covers)
    store.write(covers.filter("book_id = 2").selectExpr("book_id", "'j' as object_key", "media_type", "bytes"))
    assert {(r.book_id, r.object_key) for r in store.read().collect()} == {(1, "k"), (2, "j")}
