"""Archives on disk, restarts of streams, snapshots and full searches."""

from pyspark.sql import functions as F

from vellum.operators.lifecycle import merge_partials, project, projection_partials
from vellum.plans.unpack import unpack_books
from vellum.registry import events as ev
from vellum.registry import searching
from vellum.registry.ingest import make_archive
from vellum.sources.archives import scan_archives
from vellum.sources.events import append_outbox, build_events, file_stream, route_outbox
from vellum.streaming.envelope import with_payload
from vellum.streaming.runners import projection, vectorize_stream, write_batch

FOLDER = "/root/testdata/sf0.001"
PAGE = "<html><body><h1>Head</h1><p>text</p><footer>end</footer></body></html>"


def test_archives_are_scanned_and_a_broken_one_is_reported(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"b{i}.epub").write_bytes(make_archive(i, PAGE))
    (tmp_path / "b3.epub").write_bytes(b"not a zip")
    (tmp_path / "note.txt").write_text("no archive")
    scanned = scan_archives(spark, str(tmp_path))
    archives = scanned.select(F.regexp_extract("path", r"b(\d)\.epub", 1).cast("long").alias("book_id"), F.col("path").alias("object_name"), "content")
    out = unpack_books(archives, "bucket")
    chapters = {(r.book_id, r.chapter_id, r.chapter_title) for r in out.chapters.collect()}
    assert len(chapters) == 9 and (1, "c2", "Second 1") in chapters and (2, "c1:a:top:1", "Opening 2") in chapters
    assert {r.book_id for r in out.covers.collect()} == {0, 1, 2}
    assert {r.error.split(":")[0] for r in out.errors.collect() if r.book_id == 3} == {"BadZipFile"}
    assert {r.book_id: r.expected for r in out.plans.collect()} == {0: 3, 1: 3, 2: 3}
    first = out.chapters.filter("chapter_index = 1").first().html
    assert first.startswith('<figure><img src="data:image/png;base64,')


def started(fresh):
    d = with_payload(fresh, "BookVectorizationStarted")
    return projection_partials(d.select(
        F.col("p.bookId").cast("long").alias("book_id"), F.col("id").cast("long").alias("event_id"), F.col("occurred_at").alias("ts"),
        F.lit("Started").alias("type"), F.col("p.expectedChaptersCount").alias("expected"), F.lit(None).cast("string").alias("reason")))


def test_projection_survives_restart_and_duplicates(spark, tmp_path):
    messages = ev.messages(spark, FOLDER)
    folder = str(tmp_path)
    messages.filter("topic = 'v1.book.vectorization'").write.parquet(f"{folder}/messages")
    projection(file_stream(spark, f"{folder}/messages"), started, folder).awaitTermination()
    once = {tuple(r) for r in project(merge_partials(spark.read.parquet(f"{folder}/states").drop("batch"))).collect()}
    # the same messages delivered again to a restarted query
    messages.filter("topic = 'v1.book.vectorization'").write.mode("append").parquet(f"{folder}/messages")
    projection(file_stream(spark, f"{folder}/messages"), started, folder).awaitTermination()
    twice = {tuple(r) for r in project(merge_partials(spark.read.parquet(f"{folder}/states").drop("batch"))).collect()}
    marked = spark.read.parquet(f"{folder}/processed")
    assert once and once == twice and marked.count() == marked.select("id").distinct().count()
    assert spark.read.parquet(f"{folder}/dead").count() > 0


def test_outbox_append_adds_up(spark, tmp_path):
    rows = ev.outbox(spark, FOLDER)
    path = f"{tmp_path}/outbox"
    append_outbox(rows, path)
    append_outbox(rows.limit(0), path)
    assert spark.read.parquet(path).count() == rows.count()


def test_a_snapshot_serves_the_same_page(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    inputs = searching._requests(spark, FOLDER, [0]), searching.points(spark, FOLDER), searching.read_model(spark, FOLDER), now
    page, fresh = searching.search(*inputs, window=10)
    kept = fresh.persist()
    again, nothing = searching.search(*inputs, snapshots=kept, window=10)
    key = lambda df: {(r.query_id, r.page_rank, r.book_id, round(r.score, 6), r.next_offset) for r in df.collect()}
    assert key(page) == key(again) and nothing.count() == 0


def test_a_broken_entry_costs_its_chapter_only(spark, tmp_path):
    good, bad = bytearray(make_archive(0, PAGE)), bytearray(make_archive(1, PAGE))
    at = bad.index(b"c2.xhtml") if b"c2.xhtml" in bad else bad.index(b"C2.xhtml")
    bad[at + 12 : at + 16] = b"\xff\xff\xff\xff"  # inside the packed data of this entry
    rows = spark.createDataFrame([(0, "in/a.epub", bytes(good)), (1, "in/b.epub", bytes(bad)), (2, "in/c.epub", bytes(good[:200]))], "book_id long, object_name string, content binary")
    out = unpack_books(rows, "bucket")
    chapters = {(r.book_id, r.chapter_id) for r in out.chapters.collect()}
    assert {c for b, c in chapters if b == 0} - {c for b, c in chapters if b == 1} <= {"c2"} and (1, "c1:a:top:1") in chapters
    assert not [c for b, c in chapters if b == 2] and {r.book_id for r in out.errors.collect()} >= {2}


def test_objects_of_other_books_stay(spark, tmp_path):
    from vellum.sources.stored import write_covers, write_objects

    make = lambda rows: spark.createDataFrame(rows, "book_id long, object_name string, value string")
    path = f"{tmp_path}/objects"
    write_objects(make([(b, f"{b}/1", "old") for b in range(50)]), path)
    write_objects(make([(7, "7/1", "new"), (7, "7/2", "more"), (99, "99/1", "x")]), path)
    got = {(r.book_id, r.object_name): r.value for r in spark.read.parquet(path).collect()}
    assert len(got) == 52 and got[7, "7/1"] == "new" and got[8, "8/1"] == "old"
    covers = spark.createDataFrame([(1, "k", "image/png", b"a"), (2, "k", "image/png", b"b")], "book_id long, object_key string, media_type string, bytes binary")
    write_covers(covers, f"{tmp_path}/covers")
    write_covers(covers.filter("book_id = 2").selectExpr("book_id", "'j' as object_key", "media_type", "bytes"), f"{tmp_path}/covers")
    assert {(r.book_id, r.object_key) for r in spark.read.parquet(f"{tmp_path}/covers").collect()} == {(1, "k"), (2, "j")}


def test_an_index_answers_only_limits_it_was_cut_for(spark):
    import pytest

    from vellum.plans.suggest import build_index, suggest
    from vellum.registry import suggesting as reg
    from vellum.operators.suggestions import suggestion_rows

    b = reg.books(spark, FOLDER)
    rows = suggestion_rows(b)
    index = build_index(rows, b, limit=2)
    assert suggest(reg.asked(spark, FOLDER), rows, b, limit=2, index=index).count() > 0
    with pytest.raises(ValueError):
        suggest(reg.asked(spark, FOLDER), rows, b, limit=3, index=index)


def test_invalid_stored_chapters_stop_the_job_by_default(spark):
    import pytest

    from vellum.sources.stored import parse_chapters

    lines = spark.createDataFrame([('{"chapterId":"c","chapterTitle":"t","chapterIndex":1}',), ('{"chapterId":""}',)], "value string")
    with pytest.raises(Exception, match="invalid row"):
        parse_chapters(lines)[0].collect()
    good, bad = parse_chapters(lines, "dead_letter")
    assert good.count() == 1 and bad.count() == 1


def test_wide_vectors_are_searched_without_a_shuffle_of_points(spark):
    import numpy as np

    from vellum.operators.retrieval import dense_top_k

    r = np.random.default_rng(5)
    m = r.normal(size=(60, 1536)).astype("float32")
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "point_id long, vector array<float>")
    queries = points.filter("point_id < 9").withColumnRenamed("point_id", "query_id")
    found = dense_top_k(queries, points, 4, broadcast_bytes=20_000, block_bytes=50_000)
    unit = m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    want = {(q, rank): int(p) for q in range(9) for rank, p in enumerate(np.argsort(-(unit @ unit[q]))[:4])}
    assert {(x.query_id, x.rank0): x.point_id for x in found.collect()} == want


def test_staged_tables_can_be_cleared(spark):
    from vellum.session import clear_stages, stage_table

    kept = stage_table(spark.range(5))
    assert kept.count() == 5 and clear_stages(spark) >= 1


def test_chapters_announced_alone_are_checked_as_well(spark, tmp_path):
    """A lost object and one that holds another chapter go to the broken ones; the other chapter is not vectorised in its place."""
    folder = f"file://{tmp_path}"
    told = spark.createDataFrame([(1, "a", 1, "o/a"), (1, "lost", 2, "o/lost"), (1, "b", 3, "o/b"), (1, "c", 4, "o/c"), (1, "d", 5, "o/d")], "book_id long, chapter_id string, chapter_index int, path string")
    events = build_events(told, "ChapterExtracted", {"bookId": F.col("book_id").cast("string"), "chapterId": F.col("chapter_id"), "chapterIndex": F.col("chapter_index"),
                                                     "bucket": F.lit("b"), "s3FilePath": F.col("path"), "coverS3FilePath": F.lit(None).cast("string")}, F.col("path"))
    route_outbox(events).write.parquet(f"{folder}/messages")
    # o/b holds another id, o/c another index, o/d holds the chapter of o/a
    html = f"<p>{'Some words of a chapter. ' * 30}</p>"
    stored = spark.createDataFrame([(1, "a", 1, "o/a"), (1, "x", 3, "o/b"), (1, "c", 9, "o/c"), (1, "a", 1, "o/d")], "book_id long, chapter_id string, chapter_index int, s3_file_path string")
    objects = stored.withColumns({"batch_index": F.lit(None).cast("int"), "chapter_title": F.lit("t"), "html": F.lit(html)})

    def sink(done, events, number):
        write_batch(events.select("id", "payload", "type"), f"{folder}/events", number)
        write_batch(done.points.select("chapter_id", "chunk_index", "s3_file_path"), f"{folder}/points", number)

    load = lambda asked: objects.join(asked.select("book_id", "s3_file_path", "cover_s3_file_path").distinct(), ["book_id", "s3_file_path"])
    vectorize_stream(file_stream(spark, f"{folder}/messages"), load, sink, folder).awaitTermination()
    broken = {(r.batch_index, r.chapter_id, r.chapter_index, r.problem) for r in spark.read.parquet(f"{folder}/broken").collect()}
    assert broken == {(None, "lost", 2, "missing"), (None, "b", 3, "missing"), (None, "x", 3, "unexpected"), (None, "c", 4, "missing"), (None, "c", 9, "unexpected"), (None, "d", 5, "missing"), (None, "a", 1, "unexpected")}
    done = with_payload(spark.read.parquet(f"{folder}/events"), "ChapterVectorized").select("p.chapterId").collect()
    assert [r.chapterId for r in done] == ["a"]
    assert {(r.chapter_id, r.s3_file_path) for r in spark.read.parquet(f"{folder}/points").collect()} == {("a", "o/a")}


def test_a_query_of_many_documents_is_scored_as_a_whole(spark, tmp_path):
    from vellum.registry import everything

    spark.createDataFrame([(1, "ask")], "item_id long, text string").selectExpr("item_id - 1 AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(250).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "concat('t', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = everything().queries["g3_rerank_plugin"](spark, str(tmp_path)).collect()
    assert len(rows) == 250 and all(r.reranked and r.rerank_score is not None for r in rows)


def test_a_search_of_many_broadcasts_is_one_plan(spark):
    import numpy as np

    from vellum.operators.retrieval import dense_top_k

    m = np.random.default_rng(6).integers(-3, 4, size=(700, 6)).astype("float32")
    points = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(m)], "point_id string, vector array<float>")
    found = dense_top_k(points.withColumnRenamed("point_id", "query_id"), points, 5, broadcast_bytes=240, block_bytes=240)
    assert found._jdf.queryExecution().toString().count("InArrow") < 20
    size = np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    unit = np.divide(m, size, out=np.zeros(m.shape), where=size > 0)
    scores, names = np.round(unit @ unit.T, 8), np.array([f"p{i}" for i in range(700)])
    want = {(f"p{q}", rank): names[p] for q in range(700) for rank, p in enumerate(np.lexsort((names, -scores[q]))[:5])}
    assert {(x.query_id, x.rank0): x.point_id for x in found.collect()} == want


def test_sparse_scores_are_made_where_the_points_lie(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from vellum.operators import postings, retrieval

    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefgh") * 2 for _ in range(r.randrange(30))) for _ in range(300)]
    points = spark.createDataFrame([(i, t, i % 5 != 0) for i, t in enumerate(texts)], "point_id long, text string, is_searchable boolean")
    asked = {q: {c * 2 for c in r.sample("abcdefghxyz", 3)} for q in range(40)}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    count = [Counter(t.split()) for t in texts]
    df = Counter(t for c in count for t in c)
    want = {}
    for q, ts in asked.items():
        for i, c in enumerate(count):
            if i % 5 and any(t in c for t in ts):
                want[q, i] = sum(c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(texts[i].split()) / 256)) * math.log(1 + (300 - df[t] + 0.5) / (df[t] + 0.5)) for t in ts if t in c)
    packed = postings.point_terms(points, keep=["is_searchable"])
    for cells, pairs, broadcast in ((4_000_000, 1 << 21, 200_000), (200, 7, 200_000), (4000, 50, 50)):
        monkeypatch.setattr(retrieval, "SCORE_CELLS", cells)
        monkeypatch.setattr(retrieval, "PAIRS", pairs)
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", broadcast)
        for source in (packed, postings.build_postings(points, keep=["is_searchable"])):
            found = retrieval.sparse_scores(terms, source, postings.corpus_size(points))
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            got = {(x.query_id, x.point_id): x.score for x in found.collect()}
            assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 2e-8 for c in want)
        best = retrieval.sparse_top_k(terms, packed, postings.corpus_size(points), 6).collect()
        order = {q: sorted((-round(s, 8), i) for (a, i), s in want.items() if a == q)[:6] for q in asked}
        assert len(best) == sum(map(len, order.values())) and all(abs(order[x.query_id][x.rank0][0] + x.score) < 2e-8 for x in best)


def test_splitter_and_archives_hand_on_small_tables(spark, monkeypatch):
    import pandas as pd
    import pyarrow as pa

    from vellum.operators.chunking import split_to_rows
    from vellum.registry.ingest import make_archive
    from vellum.sources.archives import parse_archives

    made = []
    texts = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, whole string")
    books = spark.createDataFrame([(1, b"")], "book_id long, content binary")
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(type(texts), name, lambda self, f, schema: made.append(f) or self)
    split_to_rows(texts)
    parse_archives(books)
    long = "word " * 20_000
    batch = pd.DataFrame({"doc_id": range(10), "text": [long] * 10, "whole": [long] * 10})
    parts = list(made[0](iter([batch])))
    assert max(p["whole"].str.len().sum() + p["text"].str.len().sum() for p in parts) < 5 << 20 and len({(r.doc_id, r.chunk_index) for p in parts for r in p.itertuples()}) == sum(map(len, parts))
    content = [make_archive(i, "x" * 100_000) for i in range(100)]
    parts = list(made[1](iter([pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(content)], ["book_id", "content"])])))
    assert len(parts) < 100 and max(p.nbytes for p in parts) < 3 << 20 and len({i for p in parts for i in p.column("book_id").to_pylist()}) == 100
