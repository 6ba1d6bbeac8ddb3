"""Hand-computed values of rule constants and edge cases."""

import base64
import datetime

import pytest
from pyspark.sql import functions as F

from vellum.functions import html, keys, rules, scoring, text, trigram, vectors
from vellum.operators import chunking, merges, packing, ranking
from vellum.operators.ordered import running_totals


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_rank_fusion_sample_scores(spark):
    first = value(spark, scoring.rrf(F.lit(0)) + scoring.rrf(F.lit(1)))
    deep = value(spark, scoring.rrf(F.lit(40)) + scoring.rrf(F.lit(44)))
    assert first == pytest.approx(0.8333334, abs=1e-7) and deep == pytest.approx(0.045548655, abs=1e-8)


def test_limits():
    assert scoring.prefetch_limit(0, 20) == 100 and scoring.prefetch_limit(0, 100) == 404 and scoring.grouped_limit(40, 20) == 61


def test_compatibility_forms(spark):
    assert value(spark, text.normalize_query(F.lit("  Ёлка  ＡＢ ﬁx "))) == "елка ab fix"


@pytest.mark.parametrize("title,score", [("", float("-inf")), ("Page 12", -200.0), ("[Pg. 3]", -200.0), ("Footnotes:", -100.0),
                                         ("Chapter 4", 9.0), ("CHAPTER IV", 7.0), ("A long enough title here", 16.0), ("Глава", 0.0)])
def test_toc_title_score(spark, title, score):
    assert value(spark, text.toc_title_score(F.lit(title))) == score


def test_resolve_title(spark):
    resolve = lambda base, hint: value(spark, text.resolve_title(F.lit(base), F.lit(7), F.lit(hint)))
    assert resolve(" Dawn ", "x") == "Dawn" and resolve("Chapter 3", " The  End ") == "The End" and resolve("chapter 3", None) == "Chapter 7"


def test_trigrams_match_published_examples(spark):
    q, t = F.lit("word"), F.lit("two words")
    assert value(spark, trigram.similarity(trigram.trigrams(q), trigram.trigrams(t))) == pytest.approx(4 / 11)
    listed = spark.createDataFrame([("word", "two words")], "q string, t string").withColumns({"a": trigram.trigrams(F.col("q")), "b": trigram.ordered_trigrams(F.col("t"))})
    assert trigram.with_word_similarity(listed, "a", "b", "ws").first().ws == pytest.approx(0.8)


def test_image_references(spark):
    page = """<img alt=x src=a.png><img src='b&amp;c.png'><image xlink:href="d.svg"/><object data=e.gif type=x></object><img data="no.png"><p style=x><div style="background:url(f.jpg)">"""
    assert value(spark, html.image_references(F.lit(page))) == ["a.png", "b&c.png", "d.svg", "e.gif", "f.jpg"]


def test_paths(spark):
    path = lambda p: value(spark, keys.normalize_path(F.lit(p)))
    assert path("/a/../../b/./c") == "b/c" and path("..\\x\\..\\y") == "../y" and path("") == "."
    assert value(spark, keys.resolve_href(F.lit("OPS/t/a.opf"), F.lit("../i/x.png#f"))) == "OPS/i/x.png#f"
    assert value(spark, keys.segment_chapter_id(F.lit("c"), F.lit("  "), F.lit(1))) == "c:s2"
    assert value(spark, keys.target_prefix(F.lit("in/.epub"))) == "books/.epub"


def test_point_id_is_a_name_based_uuid(spark):
    made = value(spark, keys.point_id(F.lit(5), F.lit("c1"), F.lit(2)))
    assert made[14] == "5" and made[19] in "89ab" and len(made) == 36


def test_entities(spark):
    assert value(spark, html.decode_entities(F.lit("a&nbsp;&eacute;&#65;&#x1F600;&amp;lt;&nosuch;"))) == "a\u00a0éA\U0001F600&lt;&nosuch;"


def test_white_space_of_the_source_language(spark):
    assert value(spark, text.tidy_text(F.lit("\u00a0 a\u00a0\u00a0b\r\nc \n\n\n\nd\ufeff"))) == "a b\nc\n\nd"
    assert value(spark, text.normalize_suggestion(F.lit("\u3000A\u2003\u00a0B "))) == "a b"


def test_slice_edges(spark):
    page = '<p id="a">one</p><p id="b">two</p>'
    cut = lambda s, e: value(spark, html.slice_by_anchors(F.lit(page), F.lit(s).cast("string"), F.lit(e).cast("string")))
    assert cut("a", "b") == '<!doctype html><html><body><p id="a">one</p></body></html>'
    assert cut("b", "a").endswith('<body><p id="b">two</p></body></html>') and cut(None, None) == page


def test_zero_vector(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, vectors.cosine(zero, one)) == 0.0


def test_policies(spark):
    df = rules.validate(spark.range(4), {"even": F.col("id") % 2 == 0})
    good, bad = rules.apply_policy(df, "dead_letter")
    assert good.count() == 2 and bad.count() == 2
    with pytest.raises(Exception, match="invalid row"):
        rules.apply_policy(df, "fail")[0].collect()


def test_splitter_keeps_overlap_and_long_words():
    body = ". ".join(f"sentence number {i} of the text" for i in range(200))
    pieces = chunking.split_text(body)
    assert all(len(p) <= 1200 for p, _, _ in pieces) and len(pieces) > 5
    assert all(body[s:e] == p for p, s, e in pieces)
    assert all(0 < pieces[i][2] - pieces[i + 1][1] <= 200 for i in range(len(pieces) - 1))
    assert chunking.split_text("x" * 3000) == [("x" * 3000, 0, 3000)]
    for size, overlap in ((100, 100), (0, 0), (10, -1), (True, 0)):
        with pytest.raises(ValueError):
            chunking.check_limits(size, overlap)


def test_splitter_boundaries_by_hand():
    assert chunking.split_text("aa bb cc dd", 5, 0, [" "]) == [("aa bb", 0, 5), ("cc dd", 6, 11)]
    # the tail of two characters is repeated
    assert chunking.split_text("aa bb cc dd", 5, 2, [" "]) == [("aa bb", 0, 5), ("bb cc", 3, 8), ("cc dd", 6, 11)]
    # equal text at several places keeps its own offsets
    assert [s for _, s, _ in chunking.split_text("ab ab ab ab", 2, 0, [" "])] == [0, 3, 6, 9]
    # a long part is split finer, the short ones around it are packed
    assert chunking.split_text("a\nbbbb cccc\nd", 6, 0, ["\n", " "]) == [("a", 0, 1), ("bbbb", 2, 6), ("cccc", 7, 11), ("d", 12, 13)]


def test_a_text_without_offsets_is_an_error_row(spark):
    spaced = "one two. . . three four. five"
    rows = spark.createDataFrame([(1, spaced), (2, "short text"), (3, ""), (4, None)], "id int, text string")
    out = {r.id: r for r in chunking.split_to_rows(rows).collect() if r.id != 1 or r.split_error}
    assert out[1].split_error == chunking.UNMAPPED and out[1].chunk_index is None
    assert set(out) == {1, 2} and out[2].text == "short text" and out[2].split_error is None


def test_running_totals_equal_a_window_on_a_hot_key(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    got = {r.id: r.n for r in running_totals(df, ["k"], ["id"], {"n": F.lit(1)}).collect()}
    seen = {}
    for row in sorted(df.collect()):
        seen[row.k] = seen.get(row.k, 0) + 1
        assert got[row.id] == seen[row.k]


def pack_in_order(sizes, small, count, limit):
    out, batch, held, used = [], 1, 0, 0
    for size in sizes:
        if size > small:
            if held:
                batch, held, used = batch + 1, 0, 0
            out.append(None)
            continue
        if held and (held >= count or used + size > limit):
            batch, held, used = batch + 1, 0, 0
        out.append(batch)
        held, used = held + 1, used + size
        if held >= count or used >= limit:
            batch, held, used = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("limits", [(8192, 24, 512 * 1024), (8192, 24, 20000), (300, 2, 2048)])
def test_packing_equals_the_sequential_rule(spark, limits):
    sizes = [(i * 7919) % 12000 + 1 for i in range(200)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "book_id long, chapter_index int, json_bytes int")
    got = {r.chapter_index: r.batch_index for r in packing.pack_chapters(df, small_bytes=limits[0], batch_chapters=limits[1], batch_bytes=limits[2]).collect()}
    assert [got[i] for i in range(len(sizes))] == pack_in_order(sizes, *limits)


def test_upsert_keeps_insert_only_columns(spark):
    old = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, name string, html string")
    new = spark.createDataFrame([(2, None, "n2"), (3, "c", "n3")], "id int, name string, html string")
    rows = {tuple(r) for r in merges.upsert(old, new, ["id"], ["name"], ["html"]).collect()}
    assert rows == {(1, "a", "h1"), (2, None, "h2"), (3, "c", "n3")}


def test_pages_of_a_snapshot(spark):
    rows = spark.createDataFrame([(1, i, 25, more) for more in (True, False) for i in range(25)], "query_id int, position int, total int, more_after boolean")
    page = ranking.page_of(rows, F.lit(20))
    assert {(r.more_after, r.next_offset) for r in page.collect()} == {(True, 25), (False, None)}


def test_too_many_candidates_fall_back(spark):
    items = spark.createDataFrame([(1, str(i), "q", "t", "x") for i in range(5)], "query_id int, book_id string, query string, chapter_title string, text string")
    out = ranking.rerank(items, lambda: lambda pairs: [1.0] * len(pairs), max_candidates=4).collect()
    assert not any(r.reranked for r in out) and all(r.rerank_score is None for r in out)
    assert {r.rerank_error for r in out} == {"too many candidates"}


def test_a_late_or_broken_scorer_falls_back_with_a_reason(spark):
    import time

    def scorer():
        def score(pairs):
            if pairs[0][0] == "slow":
                time.sleep(3)
            if pairs[0][0] == "bad":
                raise KeyError("model")
            return [1.0] * len(pairs)

        return score

    items = spark.createDataFrame([(i, "b", q, "t", "x") for i, q in enumerate(["slow", "bad", "good"])], "query_id int, book_id string, query string, chapter_title string, text string")
    out = {r.query_id: r for r in ranking.rerank(items, scorer, timeout_seconds=0.5).collect()}
    assert [out[i].reranked for i in range(3)] == [False, False, True]
    assert "Timeout" in out[0].rerank_error and "KeyError" in out[1].rerank_error


def test_too_many_candidates_are_an_error(spark):
    items = spark.range(300).selectExpr("1 as query_id", "cast(id as int) as position", "1.0D as rerank_score")
    with pytest.raises(Exception, match="too many candidates"):
        ranking.rerank_top_k(items).collect()
    assert ranking.rerank_top_k(items.filter("position < 200")).count() == 10


def test_tolerant_timestamp(spark):
    made = value(spark, keys.tolerant_timestamp(F.lit("1700000000000")))
    assert made == datetime.datetime(2023, 11, 14, 22, 13, 20) and value(spark, keys.tolerant_timestamp(F.lit("soon"))) is None


def test_extents_of_batches_equal_the_plain_form(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from vellum.functions import trigram

    r = random.Random(2)
    pick = lambda n, top: [f"g{r.randrange(top)}" for _ in range(n)]
    queries = [None, [], ["a"], ["a"], *[list(dict.fromkeys(pick(r.randrange(12), 15))) for _ in range(400)]]
    ordered = [["a"], ["a"], None, [], *[pick(r.randrange(40), r.choice([4, 15, 40])) for _ in range(400)]]
    want = [trigram.best_extent(q or [], o or []) for q, o in zip(queries, ordered)]
    kind = pa.list_(pa.string())
    for elements in (1 << 21, 50, 1):
        monkeypatch.setattr(trigram, "_ELEMENTS", elements)
        assert np.allclose(trigram.best_extents(pa.array(queries, kind), pa.array(ordered, kind)), want, atol=1e-12)
    cut = slice(100, 200)
    assert np.allclose(trigram.best_extents(pa.array(queries, kind)[cut], pa.array(ordered, kind)[cut]), want[cut], atol=1e-12)
    assert trigram.best_extents(pa.array([], kind), pa.array([], kind)).tolist() == [] and max(want) > 0.5


def test_a_data_url_is_one_line(spark):
    data = bytes(range(200))
    assert value(spark, keys.data_url(F.lit("image/x"), F.lit(data))) == "data:image/x;base64," + base64.b64encode(data).decode()
