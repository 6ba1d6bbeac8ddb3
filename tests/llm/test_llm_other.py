"""HTML extraction, WARC archives, language ID, Hamming search, mixing and licence digests."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm import hamming_search, html_extraction, language_id, license_scan, mixing, warc

FOLDER = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{color:red}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site-header"><nav><ul><li><a href="/">Menu</a></ul></nav></header><div class="ad">Buy now and save a lot today</div>
%s<h1>The&nbsp;head &amp; more</h1><p>First  paragraph
with <b>bold</b> words &lt;3 &#233;.<p>Second<br>line <!-- not this -->here.<div class="advert">Cheap things in the middle of it all</div>
<aside><p>Side</p></aside><form><input value="x">Send</form><p>Last one closes the story with some more words.</p>%s
<section id="comments"><h2>Comments</h2><p>I liked this very much indeed</p></section><footer><p>&copy; 2024 foot</p></footer></body></html>"""
TEXT = "The head & more\nFirst paragraph with bold words <3 é.\nSecond\nline here.\nLast one closes the story with some more words."


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("<main><article class='post'>", "</article></main>"), ("<div id='content'>", "</div>")])
def test_main_text_of_a_page(marks):
    assert "\n".join(html_extraction.main_blocks(PAGE % marks, html_extraction.Weights())) == TEXT


def test_region_is_the_best_of_all():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randint(-4, 4) for _ in range(r.randint(0, 12))]
        a, b = html_extraction.best_region(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best and (best > 0 or a == b)


def test_labelled_pages_are_scanned():
    """A label is a bonus in the score: weights and scan choose the region of labelled pages too."""
    said = lambda page, w=html_extraction.Weights(): html_extraction.main_blocks(page, w)
    story = "".join(f"<p>Paragraph {k} of the story has quite a few words.</p>" for k in range(6))
    lines = [f"Paragraph {k} of the story has quite a few words." for k in range(6)]
    links = "<ul>" + "".join(f"<li><a href='/{k}'>Other {k}</a></li>" for k in range(9)) + "</ul>"
    thread = "<div><p>Nobody named this thread of answers.</p></div>"
    # <main> counts only without <article>
    assert said(f"<main><article>{story}</article>{thread}</main>") == lines
    assert said(f"<main>{story}</main>{thread}") == lines
    # a list of links inside the article is scored out, a link does not cut its paragraph
    assert said(f"<article>{story}<p>Read <a>this</a></p>{links}</article>", html_extraction.Weights(2.0, {"a": -6.0, "p": -0.5})) == [*lines, "Read this"]
    # a teaser marked as an article does not hide the text of the page
    assert said(f"<article><p>Just a teaser</p></article><div>{story * 2}</div>")[-12:] == lines * 2
    # two articles side by side are one region
    assert said(f"<article>{story}</article>\n<article>{story}</article>") == lines * 2


def test_named_parts_of_an_article_stay():
    story = "<p>The story has quite a few words, and it goes on here.</p>" * 3
    line = "The story has quite a few words, and it goes on here."
    links = "<ul>" + "".join(f"<li><a href='/{k}'>Other {k}</a></li>" for k in range(9)) + "</ul>"
    page = (f"<body><div class='site-header'>Site name and motto</div><article><header class='entry-header'><h1>The head line</h1></header>{story}<section id='related-work'><h2>Related work</h2>{story}</section>"
            f"<section id='responses'>{story}</section><div class='newsletter'>Sign up for our letter now</div><div class='comments'><p>I liked this very much indeed</p></div><div class='related'>{links}</div></article></body>")
    weights = html_extraction.Weights(2.7, {"a": -6.0, "li": -6.0, "ul": -6.0, "div": -6.0, "p": -0.5})
    assert html_extraction.main_blocks(page, weights) == ["The head line", *[line] * 3, "Related work", *[line] * 6]
    assert html_extraction.main_blocks(f"<main><div class='page-header'><h1>The head line</h1></div>{story}<div class='share'>Tell it to all</div></main>", html_extraction.Weights()) == ["The head line", *[line] * 3]


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (3, "u", "plain words only"), (None, "u", "<p>x"), (4, "u", "<article>" + "<p>long words</p>" * 20000 + "</article>"), (5, "u", "<article>a < b <b>c</b")]
    df = spark.createDataFrame([(*r, "mine", 9) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_extraction.extract(df, html_extraction.Weights()).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    said = {r.page_id: r.text for r in got}
    assert said[1] == said[2] == "" and said[3] == "plain words only" and said[4].count("\n") == 19999 and said[5].startswith("a < b c")
    assert html_extraction.learn_weights(df.limit(0)).word == html_extraction.WORD
    assert html_extraction.extract(df.limit(0), html_extraction.Weights()).count() == 0


def test_articles_of_the_test_pages(spark):
    """The labelled article is the text; without its mark the scan still finds it."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    weights = html_extraction.learn_weights(pages)
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    a = {r.page_id: r.text for r in html_extraction.extract(pages, weights).collect()}
    b = {r.page_id: r.text for r in html_extraction.extract(bare, weights).collect()}
    assert all(a.values()) and sum(a[i] == b[i] for i in a) >= 0.95 * len(a)


def payloads(seed=2):
    r = random.Random(seed)
    rows = [(i, f"http://x/{i} y", "".join(r.choice("abcé\r\n <>") for _ in range(r.choice([0, 1, 50, 3000])))) for i in range(40)]
    return rows + [(100 + k, None, rows[3][2] or "same") for k in range(5)] + [(200, "u", None), (201, "u", ""), (7, rows[7][1], rows[7][2]), (None, "u", "no key"), (None, "u", "z" * 5000)]


@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, tmp_path, least):
    rows = payloads()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, segment string")
    archives = warc.write_archives(df, "page_id", "url", "html", least, segment=700, archive=4000)
    warc.save_archives(archives, f"file://{tmp_path}/out")
    for source in (archives, warc.open_archives(spark, f"{tmp_path}/out")):
        got = warc.read_payloads(source).collect()
        assert len(got) == len(rows) and not any(r.error for r in got)
        raw = [(i, (t or "").encode()) for i, _, t in rows]
        newest = defaultdict(list)
        for i, b in raw:
            newest[b].append(i)
        want = Counter()
        for i, b in raw:
            top = max((x for x in newest[b] if x is not None), default=None)
            digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
            revisit = len(b) >= least and top is not None and i != top
            want[(warc.record_name(i, digest), "revisit" if revisit else "response", digest, warc.record_name(top, digest) if revisit else None, None if revisit else b)] += 1
        assert Counter((r.record_id, r.record_type, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.read_payloads(warc.write_archives(df.limit(0), "page_id", "url", "html")).count() == 0


def test_broken_segments_and_frames(spark):
    make = lambda rows: spark.createDataFrame(rows, warc.RECORD_DDL)
    row = lambda name, origin, k, total, block: ("a", name, "response" if origin is None else "continuation", "u", None, "d", origin, k, total, block, None)
    records = make([row("x", None, 1, None, b"ab"), row("x:2", "x", 2, 4, b"cd"), row("gap", None, 1, None, b"a"), row("gap:3", "gap", 3, 2, b"b"),
                    row("open", None, 1, None, b"a"), row("open:2", "open", 2, None, b"b"), row("size", None, 1, None, b"a"), row("size:2", "size", 2, 9, b"b"), row("whole", None, None, None, b"w")])
    got = {r.record_id: (r.error, r.block and bytes(r.block)) for r in warc.reassemble(records).collect()}
    assert got == {"x": (None, b"abcd"), "gap": ("segments are not 1 to n", None), "open": ("last segment is missing", None), "size": ("total length differs", None), "whole": (None, b"w")}
    for data in (b"", b"abc" * 9999):
        assert warc.unchunked(warc.chunked(data, 100)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nab", b"zz\r\n", b"2\r\nabXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    broken = spark.createDataFrame([("b", b"\x1f\x8bnonsense"), ("n", None), ("cut", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab")], "archive string, content binary")
    assert sum(r.error is not None for r in warc.read_records(broken).collect()) == 2


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.withColumn("lang_pred", F.lit(1)), model).filter(language_id.held_out(F.col("doc_id")))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98
    assert found.filter("score < 0 or score > 1").count() == 0
    small = language_id.fit(docs, fit_rows=100)
    assert small.languages == model.languages


def test_language_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the house and the garden"), (4, "the house and the garden"), (5, "der " * 50000), (None, "le chat")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labelled = spark.createDataFrame([("the dog and the house", "en"), ("der hund und das haus", "de"), (None, "xx"), ("no label", None), ("le chien et la maison", "fr")], "text string, lang string")
    model = language_id.fit(labelled)
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.identify(df, model).collect())
    assert got == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (None, "fr")])
    empty = language_id.fit(labelled.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0
    assert {r.doc_id for r in language_id.keep_known(df, model).collect()} == {4, 5, None}


@pytest.mark.parametrize("dims,n,k", [(12, 300, 5), (64, 200, 10), (70, 120, 10), (20, 3, 10)])
def test_nearest_codes(spark, dims, n, k):
    r = random.Random(dims)
    rows = [(i, [r.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[1][1]) for i in range(15)] + [(999, None), (None, rows[0][1]), rows[2]]
    points = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = points.filter("vec_id % 10 = 0")
    got = {(x.query_id, x.rank): (x.neighbor_id, x.distance) for x in hamming_search.top_k(points, asked, k).collect()}
    codes = {i: [v > 0 for v in e] for i, e in rows if e is not None and i is not None}
    want = {}
    for q in (i for i in codes if i % 10 == 0):
        near = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items())[:k]
        want |= {(q, at): (i, d) for at, (d, i) in enumerate(near, 1)}
    assert got == want
    assert hamming_search.top_k(points.limit(0), asked.limit(0)).count() == 0


def fill(sources, epochs):
    """Targets by repeated clamping."""
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, clamped = sum(sources.values()), set()
    while True:
        free = [s for s in names if s not in clamped and sources[s]]
        left = total - sum(epochs * sources[s] for s in clamped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > epochs * sources[s]}
        if not over:
            return target | {s: epochs * sources[s] for s in clamped} | {s: 0.0 for s in names if not sources[s]}
        clamped |= over


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choices(["a", "b", "B", "é", None, "tiny"], [50, 5, 5, 9, 3, 0])[0]) for i in range(600)]
    rows += [(1000, "one two three", "tiny"), (1001, "x " * 20000, "a"), (1002, None, "void"), (1003, "", None), rows[0], (None, "p q", "b")]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id bigint, text string, source string, size int")
    got = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes, 3)
    taken = defaultdict(int)
    for x in got:
        assert x.size == len((x.text or "").split()) and 0 <= x.taken <= 3 * x.size and x.source_size == sizes[x.source]
        assert x.target == pytest.approx(want[x.source])
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 5 for s in want)
    assert want["tiny"] == 9 and taken["tiny"] == 9
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_water_fill_with_few_epochs(spark):
    df = spark.createDataFrame([("a", 100, 1.0), ("b", 10, 5.0), ("c", 10, 5.0), ("d", 0, 1.0), ("e", 5, 0.0)], "key string, amount bigint, weight double")
    got = {r.key: r.target for r in mixing.water_fill(df, 2.0).collect()}
    assert got == {"a": 85.0, "b": 20.0, "c": 20.0, "d": 0.0, "e": 0.0}


def test_licence_digests(spark):
    mit = dict(license_scan.KNOWN)["MIT"]
    rows = [(1, mit), (2, mit.upper().replace("<year> <copyright holders>".upper(), "2020 Somebody Else, Inc.")), (3, mit.replace("\n\n", "\n   \n").replace('"', "'")), (4, mit + " and more"), (5, None), (6, "?!"),
            (7, "released under the MIT LICENCE"), (7, "released under the MIT LICENCE"), (8, "word " * 100000), (None, mit.replace("copyright holders", "copyright owners", 0))]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], "doc_id bigint, text string, license_id string, license_digest string")
    got = Counter((r.doc_id, r.license_id) for r in license_scan.scan(df, license_scan.published(spark)).collect())
    assert got == Counter([(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None), (7, "MIT-statement"), (7, "MIT-statement"), (8, None), (None, "MIT")])
    assert {r.license_digest for r in license_scan.scan(df, license_scan.published(spark).limit(0)).collect() if r.doc_id in (5, 6)} == {None}
    lines = license_scan.scan_lines(df.filter("doc_id = 7").limit(1), license_scan.published(spark)).collect()
    assert [(r.line_no, r.license_id) for r in lines] == [(0, "MIT-statement")]
    assert license_scan.scan(df.limit(0), license_scan.published(spark)).count() == 0


def test_copyright_notices_end(spark):
    """Only the notice goes: what follows on its line, and clauses numbered (c), count."""
    mit = dict(license_scan.KNOWN)["MIT"]
    flat = " ".join(mit.split())
    head, body = "Copyright (c) <year> <copyright holders>", flat.split("holders> ", 1)[1]
    mits = {f"{opening} {body}" for opening in (
        "MIT License Copyright 2020 X.", "MIT License Copyright (c) 2020-2024 Acme, Inc.", "MIT License Copyright (c) 2020 J. R. Smith and others", "MIT License\n(c) 2019, 2021 Acme GmbH.\n",
        "MIT License\nCopyright © 2020 A\nCopyright 2021 B. All rights reserved.\n", "MIT License\n© Copyright 2020 by A, B and C <a@b.org>\n", "MIT License\nCopyright (c) Acme Inc. and contributors\n")}
    article = "tells at length and with no stop " * 20
    others = [mit + "\n(c) 30 days after notice this ends.", mit + "\n(c) [..]", mit + "\n(c) copies are counted", f"(c) 2024 Acme {article}\nReleased under the MIT License.", f"(c) 2024 Acme. {article}", f"Copyright 2020 X. {body} And more.",
              f"Copyright 2020 X {article}", mit.replace(head, head + " " + article)]
    rows = [(t,) for t in [*sorted(mits), *others, "Copyright 2020 X. Released under the MIT License.", "(c) 2020 Acme"]]
    got = {r.text: r for r in license_scan.scan(spark.createDataFrame(rows, "text string"), license_scan.published(spark)).collect()}
    assert {t for t in mits if got[t].license_id != "MIT"} == set()
    assert all(got[t].license_id is None and got[t].license_digest for t in others) and len({got[t].license_digest for t in others}) == len(others)
    assert got["Copyright 2020 X. Released under the MIT License."].license_id == "MIT-statement"
    assert got["(c) 2020 Acme"].license_digest is None


def test_planted_licences_and_their_sql(spark, tmp_path):
    """Whole texts with holders, other spellings, line breaks and markers are found; changed ones are not; the SQL gives the same rows."""
    import duckdb

    from vellum.llm.registry import R

    texts = list(license_scan.KNOWN)
    fill = lambda t: t.replace("<year>", "2021").replace("<owner>", "Acme, Inc.").replace("<copyright holders>", "J. R. Smith")
    rows, want = [], {}
    for k, (name, text) in enumerate(texts):
        made = fill(text)
        for j, said in enumerate([made, made.upper().replace(",", ""), "\n".join(" * " + x for x in made.replace(" the ", " the\n").split("\n")), re.sub(r"\b(sub)?license\b", r"\1licence", made).replace(" ", "  ")]):
            rows.append((10 * k + j, said))
            want[10 * k + j] = name
        rows.append((10 * k + 5, made + " As amended."))
        want[10 * k + 5] = None
    odd = ["Copyright 2020 A Copyright 2021 B\nReleased under the MIT License.", "© Copyright 2020 by A, B\nx (c) 2019 y", "", "?!", None, "a.b. e.g. Inc. co.", "Copyright (c) 2020 Acme. All rights reserved. Released under the MIT License.",
           "(c) 30 days after notice", "\x01 copyright 2020 X\x01tail", "All rights reserved.\n text"]
    rows += [(9000 + k, t) for k, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in R.queries["op8_license_digest"](spark, str(tmp_path)).collect()}
    assert {i: (got[i].license_id or None) for i in want} == want
    assert got[9000].license_id == got[9006].license_id == "MIT-statement"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    twin = {i: (d, n) for i, d, n in con.execute(f"SELECT doc_id, license_digest, license_id FROM ({R.sql['op8_license_digest']})").fetchall()}
    assert {i: (r.license_digest, r.license_id) for i, r in got.items()} == twin
