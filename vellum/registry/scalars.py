"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import headers, html, keys, scoring, text, trigram, vectors
from vellum.functions.rules import errors_of, search_request_rules, suggest_request_rules, upload_request_rules, book_request_rules
from vellum.operators.packing import stored_bytes, stored_json
from vellum.operators.postings import build_postings
from vellum.registry import Registry, table
from vellum.session import union_all

R = Registry()

# --- fragments of the SQL twins ---------------------------------------------------------------
STOP = "'a','about','an','and','book','books','for','in','of','on','the','with','без','в','для','и','книга','книге','книги','книгу','о','об','про','с'"
FRONT = "annotation|foreword|introduction|preface|аннотация|благодарности|введение|вступление|предисловие"
FRONT_LIST = "['" + FRONT.replace("|", "','") + "']"


def norm(c: str) -> str:
    return f"translate(nfc_normalize(lower({c})), 'ё', 'е')"


def toks(c: str) -> str:
    return f"regexp_extract_all({norm(c)}, '[\\p{{L}}\\p{{N}}]+')"


def terms(c: str) -> str:
    """Distinct kept tokens in first-seen order."""
    kept = f"list_filter({toks(c)}, lambda t: length(t) >= 3 and t not in ({STOP}))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


def trg_list(c: str) -> str:
    """Ordered trigrams, duplicates kept."""
    return (
        f"flatten(list_transform(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"
    )


# titles for title rules: headings, names, page markers, numbered chapters
TITLES = """
  SELECT regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title FROM pages
  UNION SELECT p_name FROM part UNION SELECT p_type || ' ' || p_brand FROM part
  UNION SELECT upper(p_name) FROM part
  UNION SELECT c_name FROM customer UNION SELECT 'page ' || n_nationkey FROM nation
  UNION SELECT '[Pg. ' || n_nationkey || ']' FROM nation UNION SELECT 'Chapter ' || n_nationkey FROM nation
  UNION SELECT 'The Book of ' || n_name FROM nation UNION SELECT 'footnotes:' || repeat('x', r_regionkey) FROM region
"""


def titles(spark, sf):
    pages, part, customer, nation, region = (table(spark, sf, n) for n in ("pages", "part", "customer", "nation", "region"))
    number = F.col("n_nationkey").cast("string")
    parts = [
        pages.select(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("title")),
        part.select("p_name"), part.select(F.concat_ws(" ", "p_type", "p_brand")), part.select(F.upper("p_name")), customer.select("c_name"),
        nation.select(F.concat(F.lit("page "), number)), nation.select(F.concat(F.lit("[Pg. "), number, F.lit("]"))),
        nation.select(F.concat(F.lit("Chapter "), number)), nation.select(F.concat(F.lit("The Book of "), F.col("n_name"))),
        region.select(F.concat(F.lit("footnotes:"), F.expr("repeat('x', r_regionkey)"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


# --- X1..X6 -----------------------------------------------------------------------------------
@R.add("x1_normalize_search_text", f"SELECT doc_id, md5({norm('text')}) AS digest, length({norm('text')})::BIGINT AS chars FROM documents")
def x1(spark, sf):
    n = text.normalize_search_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n.alias("n")).select(
        "doc_id", F.md5("n").alias("digest"), F.length("n").cast("long").alias("chars"))


@R.add("x2_normalize_query", f"SELECT item_id, trim(regexp_replace({norm('text')}, '\\s+', ' ', 'g')) AS query FROM benchmark")
def x2(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.normalize_query(F.col("text")).alias("query"))


@R.add("x3_tokenize", f"""
  SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf
  FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY term""")
def x3(spark, sf):
    from vellum.operators.postings import term_counts

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "text")
    return term_counts(build_postings(docs))


@R.add("x4_query_features", f"""
  SELECT item_id, array_to_string({terms('text')}, ' ') AS terms,
    NOT list_has_any({toks('text')}, {FRONT_LIST}) AND len({terms('text')}) > 0 AS demote
  FROM benchmark""")
def x4(spark, sf):
    from vellum.operators.ranking import query_features

    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"))
    return query_features(q).select("item_id", F.array_join("terms", " ").alias("terms"), "demote")


_OPENED = f"CASE WHEN doc_id % 5 = 0 THEN ' Preface: ' || text ELSE text END"


@R.add("x5_front_matter", f"""
  SELECT doc_id, regexp_matches({norm(f'ltrim({_OPENED})')}, '^({FRONT})')
     OR (doc_id % 2 = 0 AND regexp_matches(lower(CASE WHEN doc_id % 3 = 0 THEN 'Part ' || doc_id ELSE lang END), '^(chapter|глава|part|часть) [0-9]+$')) AS front_matter
  FROM documents""")
def x5(spark, sf):
    d = table(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" Preface: "), F.col("text"))).otherwise(F.col("text"))
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Part "), F.col("doc_id").cast("string"))).otherwise(F.col("lang"))
    return d.select("doc_id", text.is_front_matter(title, body, (F.col("doc_id") % 2).cast("int")).alias("front_matter"))


@R.add("x6_normalize_suggestion", """
  SELECT c_custkey, regexp_replace(trim(lower('  ' || c_name || chr(9) || ' ' || c_mktsegment)), '\\s+', ' ', 'g') AS value FROM customer""")
def x6(spark, sf):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit("\t "), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", text.normalize_suggestion(raw).alias("value"))


# --- X7..X10 trigrams -------------------------------------------------------------------------
@R.add("x7_trigrams", f"""
  SELECT title, array_to_string(list_sort(list_distinct({trg_list('title')})), '|') AS grams FROM ({TITLES})""")
def x7(spark, sf):
    return titles(spark, sf).select("title", F.array_join(F.array_sort(trigram.trigrams(F.col("title"))), "|").alias("grams"))


_TYPO = "left(p_name, 2) || substring(p_name, 4)"
_PAIRS = f"SELECT DISTINCT {_TYPO} AS q, p_name || ' ' || lower(p_type) AS v FROM part"


def pairs(spark, sf):
    typo = F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1000))
    return table(spark, sf, "part").select(typo.alias("q"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("v")).distinct()


_SIM = "coalesce(len(list_intersect(qs, vs))::DOUBLE / nullif(len(list_distinct(list_concat(qs, vs))), 0), 0)"
_PAIR_SETS = f"SELECT q, v, list_distinct({trg_list('q')}) AS qs, list_distinct({trg_list('v')}) AS vs, {trg_list('v')} AS vl FROM ({_PAIRS})"


@R.add("x8_similarity", f"SELECT q, v, round({_SIM}, 6) AS similarity FROM ({_PAIR_SETS})")
def x8(spark, sf):
    sim = trigram.similarity(trigram.trigrams(F.col("v")), trigram.trigrams(F.col("q")))
    return pairs(spark, sf).select("q", "v", F.round(sim, 6).alias("similarity"))


def word_sim_sql(source: str, keys_: str) -> str:
    """Brute force over every extent of the ordered list `vl` that starts and ends on a member of the set `qs`; others score less."""
    return f"""
      SELECT {keys_}, max(len(list_intersect(list_distinct(vl[i:j]), qs))::DOUBLE /
        (len(qs) + len(list_distinct(vl[i:j])) - len(list_intersect(list_distinct(vl[i:j]), qs)))) AS ws
      FROM (SELECT *, unnest(list_filter(range(i, len(vl) + 1), lambda x: list_contains(qs, vl[x]))) AS j
        FROM (SELECT *, unnest(CASE WHEN list_has_any(vl, qs) THEN list_filter(range(1, len(vl) + 1), lambda x: list_contains(qs, vl[x])) ELSE [1::BIGINT] END) AS i FROM {source}))
      GROUP BY {keys_}"""


@R.add("x9_word_similarity", f"WITH s AS ({_PAIR_SETS}) SELECT q, v, round(ws, 6) AS word_similarity FROM ({word_sim_sql('s', 'q, v')})")
def x9(spark, sf):
    return _measured(pairs(spark, sf)).select("q", "v", F.round("ws", 6).alias("word_similarity"))


def _measured(p):
    listed = p.withColumns({"qs": trigram.trigrams(F.col("q")), "vl": trigram.ordered_trigrams(F.col("v"))})
    return trigram.with_word_similarity(listed, "qs", "vl", "ws").drop("qs", "vl")


def score_sql(q: str, v: str, sim: str, ws: str) -> str:
    return f"""((CASE WHEN {v} = {q} THEN 1000 ELSE 0 END) + (CASE WHEN {v} LIKE {q} || '%' THEN 700 ELSE 0 END)
      + (CASE WHEN {v} LIKE '% ' || {q} || '%' THEN 500 ELSE 0 END) + (CASE WHEN strpos({v}, {q}) > 0 THEN 100 ELSE 0 END)
      + (CASE WHEN length({q}) >= 3 THEN (greatest({sim}, {ws})::FLOAT::DOUBLE * 100)::INTEGER ELSE 0 END))::INTEGER"""


@R.add("x10_suggestion_score", f"""
  WITH s AS ({_PAIR_SETS}), w AS ({word_sim_sql('s', 'q, v')}),
  m AS (SELECT s.q, s.v, {_SIM} AS sim, ws FROM s JOIN w ON s.q = w.q AND s.v = w.v)
  SELECT q, v, {score_sql('q', 'v', 'sim', 'ws')} AS score FROM m
  UNION ALL SELECT left(v, 4), v, {score_sql('left(v, 4)', 'v', '0', '0')} FROM m""")
def x10(spark, sf):
    p = pairs(spark, sf)
    q, v = F.col("q"), F.col("v")
    sim = trigram.similarity(trigram.trigrams(v), trigram.trigrams(q))
    scored = _measured(p).select("q", "v", trigram.suggestion_score(v, q, sim, F.col("ws")).alias("score"))
    prefix = F.substring("v", 1, 4)
    none = F.lit(0.0)
    return union_all(scored, p.select(prefix.alias("q"), "v", trigram.suggestion_score(v, prefix, none, none).alias("score")))


# --- X11..X14 markup --------------------------------------------------------------------------
_BLOCK = "article|aside|blockquote|dd|div|figcaption|figure|h[1-6]|header|li|p|section|table|td|th|tr|ul|ol"


def html_text_sql(c: str) -> str:
    """Body markup to raw text by a chain of replacements."""
    s = f"regexp_replace({c}, '(?i)<br\\s*/?>', chr(10), 'g')"
    s = f"regexp_replace({s}, '(?i)(</({_BLOCK})>)', '\\1' || chr(10), 'g')"
    s = f"regexp_extract({s}, '(?is)<body[^>]*>(.*?)(</body>|$)', 1)"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style"):
        s = f"regexp_replace({s}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    s = f"regexp_replace({s}, '</?[A-Za-z][^>]*>', '', 'g')"
    for name, value in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        s = f"replace({s}, '{name}', '{value}')"
    return s


def tidy_sql(c: str) -> str:
    s = f"regexp_replace(replace({c}, chr(160), ' '), '\\r\\n?', chr(10), 'g')"
    s = f"regexp_replace(regexp_replace({s}, '[ \\t\\f\\v]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    return f"trim(regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def paragraphs_sql(c: str) -> str:
    """Protect paragraph breaks, join lines, restore the breaks."""
    s = f"replace({tidy_sql(c)}, chr(10) || chr(10), chr(1))"
    s = f"regexp_replace(replace({s}, chr(10), ' '), ' {{2,}}', ' ', 'g')"
    s = f"regexp_replace({s}, ' *' || chr(1) || ' *', chr(1), 'g')"
    return f"replace({s}, chr(1), chr(10) || chr(10))"


@R.add("x11_html_to_text", f"""
  SELECT page_id, md5(t) AS digest, length(t)::BIGINT AS chars FROM (SELECT page_id, {paragraphs_sql(html_text_sql('html'))} AS t FROM pages)""")
def x11(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.html_to_text(F.col("html")).alias("t")).select(
        "page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


@R.add("x12_normalize_text", f"""
  SELECT doc_id, md5({tidy_sql('text')}) AS tidy, md5({paragraphs_sql('text')}) AS paragraphs FROM documents""")
def x12(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.tidy_text(F.col("text"))).alias("tidy"), F.md5(text.tidy_paragraphs(F.col("text"))).alias("paragraphs"))


_HINT = "trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@R.add("x13_chapter_content", f"""
  SELECT page_id, {_HINT} AS title_hint, length({tidy_sql(html_text_sql('html'))})::BIGINT AS plain_chars FROM pages""")
def x13(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", html.title_hint(h).alias("title_hint"), F.length(html.chapter_plain_text(h)).cast("long").alias("plain_chars"))


_ANCHORED = "replace(replace(html, '<h1>', '<h1 class=\"t\" id=\"top.' || page_id || '\">'), '<footer>', '<a name=''end+''></a><footer>')"


@R.add("x14_slice_by_anchors", f"""
  SELECT page_id, md5(CASE page_id % 4
    WHEN 0 THEN '<!doctype html><html><body>' || trim(substring(h, s, e - s)) || '</body></html>'
    WHEN 1 THEN '<!doctype html><html><body>' || trim(substring(h, s)) || '</body></html>'
    WHEN 2 THEN CASE WHEN contains(substring(h, 1, e - 1), '<html') THEN trim(substring(h, 1, e - 1)) ELSE h END
    ELSE h END) AS digest
  FROM (SELECT page_id, h, strpos(h, '<h1 class') AS s, strpos(h, '<a name') AS e FROM (SELECT page_id, {_ANCHORED} AS h FROM pages))""")
def x14(spark, sf):
    p = table(spark, sf, "pages")
    pid = F.col("page_id").cast("string")
    h = F.replace(
        F.replace(F.col("html"), F.lit("<h1>"), F.concat(F.lit('<h1 class="t" id="top.'), pid, F.lit('">'))),
        F.lit("<footer>"), F.lit("<a name='end+'></a><footer>"))
    kind = F.col("page_id") % 4
    start = F.when(kind.isin(0, 1), F.concat(F.lit("top."), pid)).when(kind == 3, F.lit("nowhere"))
    end = F.when(kind.isin(0, 2), F.lit("end+"))
    whole = F.when(kind == 3, F.col("h")).otherwise(html.slice_by_anchors(F.col("h"), start, end))
    # a start that is not there means the start of the file, so the whole file comes back
    sliced = p.select("page_id", h.alias("h")).select("page_id", whole.alias("w"), html.slice_by_anchors(F.col("h"), F.lit("nowhere"), F.lit(None).cast("string")).alias("all"), "h")
    return sliced.select("page_id", F.md5(F.when(kind == 3, F.col("all")).otherwise(F.col("w"))).alias("digest"))


# --- X15..X25 keys ----------------------------------------------------------------------------
@R.add("x15_href_tools", """
  SELECT page_id, regexp_replace(url, '/+', '/', 'g') AS pass_through,
    'OPS/' || regexp_extract(url, '//(.*?)[?#]', 1) || '.xhtml' AS resolved,
    'fr ' || page_id AS fragment,
    coalesce(nullif(regexp_extract(url, '[^/]*$'), ''), url) AS file_name
  FROM pages""")
def x15(spark, sf):
    p = table(spark, sf, "pages")
    host_path = F.regexp_extract("url", r"//(.*?)[?#]", 1)
    href = F.concat(F.lit("../x/./../"), host_path, F.lit(".xhtml#fr%20"), F.col("page_id").cast("string"))
    r = keys.resolve_href(F.lit("OPS/text/book.opf"), href)
    return p.select(
        "page_id", keys.resolve_href(F.lit("a/b.opf"), F.col("url")).alias("pass_through"),
        keys.normalize_href(r).alias("resolved"), keys.fragment_of(r).alias("fragment"), keys.file_name(F.col("url")).alias("file_name"))


@R.add("x16_toc_title_score", f"""
  WITH t AS (SELECT title, length(regexp_replace(title, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(title, '[^A-Z]', '', 'g')) AS caps FROM ({TITLES}))
  SELECT title, (CASE WHEN regexp_matches(title, '(?i)^\\[?\\s*(pg|page)\\.?\\s*\\d+\\s*\\]?$') THEN -200
     WHEN regexp_matches(title, '(?i)^footnotes?:?$') THEN -100
     ELSE (CASE WHEN letters > 0 THEN 10 ELSE 0 END) + (CASE WHEN length(title) >= 16 THEN 6 ELSE 0 END)
        + (CASE WHEN regexp_matches(title, '(?i)\\b(chapter|part|book)\\b') THEN 2 ELSE 0 END)
        - (CASE WHEN regexp_matches(title, '(?i)^\\s*(chapter|part|book)\\s+[ivxlcdm\\d]+\\s*$') THEN 3 ELSE 0 END)
        - (CASE WHEN letters > 0 AND caps::DOUBLE / letters > 0.8 THEN 2 ELSE 0 END) END)::DOUBLE AS score
  FROM t""")
def x16(spark, sf):
    return titles(spark, sf).select("title", text.toc_title_score(F.col("title")).alias("score"))


_BASE = "CASE WHEN page_id % 2 = 0 THEN ' CHAPTER  ' || page_id ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END"


@R.add("x17_resolve_title", f"""
  SELECT page_id, CASE WHEN page_id % 2 = 1 THEN trim({_BASE}) WHEN page_id % 6 = 0 THEN 'Chapter ' || (page_id + 1)
    ELSE left({_HINT}, 120) END AS title FROM pages""")
def x17(spark, sf):
    p = table(spark, sf, "pages")
    pid = F.col("page_id")
    base = F.when(pid % 2 == 0, F.concat(F.lit(" CHAPTER  "), pid.cast("string"))).otherwise(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    hint = F.when(pid % 6 != 0, html.title_hint(F.col("html")))
    return p.select("page_id", text.resolve_title(base, (pid + 1).cast("int"), hint).alias("title"))


_ANCHOR = "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '#!' ELSE '--' || p_name || ' & ' || p_type || repeat('z', p_size) END"


@R.add("x18_segment_chapter_id", f"""
  SELECT p_partkey, CASE WHEN anchor IS NULL THEN CASE WHEN i = 0 THEN base ELSE base || ':s' || (i + 1) END
    WHEN slug = '' THEN base || ':s' || (i + 1) ELSE base || ':a:' || slug || ':' || (i + 1) END AS chapter_id
  FROM (SELECT p_partkey, p_brand AS base, p_size % 3 AS i, {_ANCHOR} AS anchor,
    left(trim(regexp_replace(lower({_ANCHOR}), '[^a-z0-9_-]+', '-', 'g'), '-'), 48) AS slug FROM part)""")
def x18(spark, sf):
    k = F.col("p_partkey")
    anchor = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("#!")).otherwise(
        F.concat(F.lit("--"), F.col("p_name"), F.lit(" & "), F.col("p_type"), F.expr("repeat('z', p_size)")))
    return table(spark, sf, "part").select("p_partkey", keys.segment_chapter_id(F.col("p_brand"), anchor, F.col("p_size") % 3).alias("chapter_id"))


@R.add("x19_object_keys", """
  SELECT c_custkey, 'books/' || slug AS prefix,
    'books/' || slug || '/chapters/' || lpad(c_nationkey::VARCHAR, 6, '0') || '-' || lower(c_mktsegment) || '.json' AS chapter,
    'books/' || slug || '/chapter-batches/batch-' || lpad(c_nationkey::VARCHAR, 6, '0') || '.json' AS batch,
    'books/' || slug || '/cover/original.' || CASE WHEN c_custkey % 2 = 0 THEN 'png' ELSE 'bin' END AS cover
  FROM (SELECT *, trim(regexp_replace(lower(c_name), '[^a-z0-9._-]+', '-', 'g'), '-') AS slug FROM customer)""")
def x19(spark, sf):
    c = table(spark, sf, "customer").withColumn("prefix", keys.target_prefix(F.concat(F.lit("in/"), F.col("c_name"), F.lit(".epub"))))
    p = F.col("prefix")
    ext = F.when(F.col("c_custkey") % 2 == 0, F.lit(".PNG")).otherwise(F.lit("p/g"))
    return c.select(
        "c_custkey", "prefix", keys.chapter_object(p, F.col("c_nationkey"), F.col("c_mktsegment")).alias("chapter"),
        keys.batch_object(p, F.col("c_nationkey")).alias("batch"), keys.cover_object(p, ext).alias("cover"))


@R.add("x20_point_id", """
  SELECT doc_id, left(h, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' ||
    ['8','9','a','b'][(strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1] || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id
  FROM (SELECT doc_id, sha1(source || ':' || doc_id || ':' || 1) AS h FROM documents)""")
def x20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", keys.point_id(F.col("source"), F.col("doc_id").cast("string"), F.lit(1)).alias("point_id"))


@R.add("x21_snapshot_key", f"""
  SELECT item_id, 'search:rerank-snapshot:v1:w100:' || sha256(trim(regexp_replace({norm('text')}, '\\s+', ' ', 'g'))) AS cache_key FROM benchmark""")
def x21(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", keys.snapshot_key(text.normalize_query(F.col("text"))).alias("cache_key"))


@R.add("x22_snowflake", """
  SELECT event_id, ((ms << 22) | ((user_id % 32) << 17) | ((event_id % 32) << 12) | (event_id % 4096))::BIGINT AS id,
    (ms + 1767225600000)::BIGINT AS at_ms, (user_id % 32)::BIGINT AS datacenter, (event_id % 32)::BIGINT AS worker, (event_id % 4096)::BIGINT AS sequence
  FROM (SELECT event_id, user_id, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM events)""")
def x22(spark, sf):
    # the events are two years older than the id epoch, so they are moved by the difference
    e = table(spark, sf, "events")
    at = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000 + 1767225600000)
    made = e.select("event_id", keys.snowflake(at, F.col("user_id"), F.col("event_id"), F.col("event_id")).alias("id"))
    parts = keys.snowflake_parts(keys.parse_snowflake(F.col("id").cast("string")))
    return made.withColumn("p", parts).select(
        "event_id", "id", F.unix_millis("p.at").alias("at_ms"), "p.datacenter", "p.worker", "p.sequence")


@R.add("x23_safe_file_name", """
  SELECT page_id, page_id || '/1700000000000_u-' || page_id || '_' || left(regexp_replace(url, '[^\\w.\\-]+', '_', 'g'), 120) || '.epub' AS object_key FROM pages""")
def x23(spark, sf):
    pid = F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id", keys.upload_key(pid, F.lit(1700000000000), F.concat(F.lit("u-"), pid.cast("string")), F.col("url")).alias("object_key"))


@R.add("x24_tolerant_timestamp", """
  SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE epoch_us(ts) // 1000 END AS at_ms FROM events""")
def x24(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.unix_millis("t").cast("string"))
        .when(F.col("event_id") % 3 == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.concat(F.lit("at "), F.col("event_type"))))
    return e.select("event_id", F.unix_millis(keys.tolerant_timestamp(raw)).alias("at_ms"))


@R.add("x25_headers", """
  SELECT event_id, event_type AS kind, CASE WHEN value < 50 THEN NULL ELSE 'second' END AS repeated,
    CASE event_id % 3 WHEN 0 THEN (event_id % 7)::DOUBLE ELSE 0 END AS attempt
  FROM events""")
def x25(spark, sf):
    e = table(spark, sf, "events")
    def h(name, value):
        return F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))
    attempt = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7).cast("string")).when(F.col("event_id") % 3 == 1, F.lit("-4")).otherwise(F.lit("x"))
    listed = F.array(
        h("x-event-type", F.col("event_type")), h("r", F.lit(None)), h("r", F.when(F.col("value") >= 50, F.lit("second"))), h("attempt", attempt))
    m = e.select("event_id", headers.header_map(listed).alias("m"))
    return m.select(
        "event_id", F.try_element_at("m", F.lit("x-event-type")).alias("kind"), F.try_element_at("m", F.lit("r")).alias("repeated"),
        headers.attempt_of(F.try_element_at("m", F.lit("attempt"))).alias("attempt"))


# --- X26..X35 ---------------------------------------------------------------------------------
@R.add("x26_cosine", """
  SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def x26(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@R.add("x27_bm25_weight", f"""
  WITH t AS (SELECT doc_id, unnest({toks('text')}) AS term FROM documents),
  p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM t GROUP BY ALL),
  l AS (SELECT doc_id, count(*)::DOUBLE AS len FROM t GROUP BY ALL),
  d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
  SELECT doc_id, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 256)) * ln(1 + (n - df + 0.5) / (df + 0.5))), 4) AS weight
  FROM p JOIN l USING (doc_id) JOIN d USING (term), n GROUP BY doc_id""")
def x27(spark, sf):
    from vellum.operators.postings import corpus_size, document_frequency

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "text")
    p = build_postings(docs)
    w = scoring.bm25_weight(F.col("tf"), F.col("doc_len")) * scoring.idf(corpus_size(docs), F.col("df"))
    return p.join(document_frequency(p), "term").groupBy(F.col("point_id").alias("doc_id")).agg(F.round(F.sum(w), 4).alias("weight"))


@R.add("x28_rrf", """
  WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS r, s_nationkey FROM supplier),
  b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_name DESC, s_suppkey) - 1 AS r FROM supplier)
  SELECT s_suppkey, round(1.0::DOUBLE / (2 + a.r) + 1.0::DOUBLE / (2 + b.r), 6) AS score FROM a JOIN b USING (s_suppkey)""")
def x28(spark, sf):
    from vellum.operators.ordered import running_totals
    from vellum.operators.retrieval import fuse

    s = table(spark, sf, "supplier").withColumns({"_a": -F.col("s_acctbal"), "query_id": F.lit(0), "point_id": F.col("s_suppkey")})
    first = running_totals(s, [], ["_a", "s_suppkey"], {"n": F.lit(1)})
    top = s.agg(F.count(F.lit(1)).alias("n")).scalar()
    second = running_totals(s, [], ["s_name", "s_suppkey"], {"n": F.lit(1)}).withColumn("n", top - F.col("n") + 1)
    lists = [d.select("query_id", "point_id", (F.col("n") - 1).alias("rank0")) for d in (first, second)]
    return fuse(lists).select(F.col("point_id").alias("s_suppkey"), F.round("score", 6).alias("score"))


_MATCH = f"""
  SELECT doc_id, {terms('b.text')} AS terms, NOT list_has_any({toks('b.text')}, {FRONT_LIST}) AND len({terms('b.text')}) > 0 AS demote,
    {norm("'Chapter ' || d.doc_id || chr(10) || d.text")} AS hay, (doc_id % 3)::DOUBLE / 3 AS score,
    regexp_matches({norm('ltrim(d.text)')}, '^({FRONT})') OR d.doc_id % 2 = 0 AS front
  FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id"""
_OVER = f"SELECT *, len(list_filter(terms, lambda t: contains(hay, t)))::INTEGER AS overlap FROM ({_MATCH})"


def matches(spark, sf):
    """Every document as a search hit of one benchmark text."""
    from vellum.operators.ranking import query_features, with_policy_inputs

    b = table(spark, sf, "benchmark")
    q = query_features(b.select("item_id", F.col("text").alias("query")))
    n = b.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % n).alias("item_id"), "text", F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")).alias("chapter_title"),
        (F.col("doc_id") % 2).cast("int").alias("source_start_char"), ((F.col("doc_id") % 3) / 3).alias("score"))
    return with_policy_inputs(q.join(d, "item_id"))


@R.add("a9_term_overlap", f"SELECT doc_id, overlap FROM ({_OVER})")
def a9(spark, sf):
    return matches(spark, sf).select("doc_id", "overlap")


@R.add("x29_representative_score", f"""
  SELECT doc_id, round(score + 2 * overlap + (overlap > 0)::INTEGER - CASE WHEN demote AND overlap = 0 AND front THEN 1.5::DOUBLE ELSE 0 END, 6) AS score FROM ({_OVER})""")
def x29(spark, sf):
    s = scoring.representative_score(F.col("score"), F.col("overlap"), F.col("demote"), F.col("front_matter"))
    return matches(spark, sf).select("doc_id", F.round(s, 6).alias("score"))


@R.add("x30_ranked_book_score", f"""
  SELECT doc_id, round(coalesce(CASE WHEN doc_id % 2 = 0 THEN 0.25::DOUBLE END, score) + CASE WHEN overlap > 0 THEN 1 + 0.35::DOUBLE * overlap ELSE 0 END
    - CASE WHEN demote AND overlap = 0 AND front THEN 0.8::DOUBLE ELSE 0 END + score * 0.05::DOUBLE, 6) AS score FROM ({_OVER})""")
def x30(spark, sf):
    rerank = F.when(F.col("doc_id") % 2 == 0, 0.25)
    s = scoring.ranked_book_score(F.col("score"), rerank, F.col("overlap"), F.col("demote"), F.col("front_matter"))
    return matches(spark, sf).select("doc_id", F.round(s, 6).alias("score"))


@R.add("x31_rerank_text", """
  SELECT doc_id, md5(left(trim(CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) || chr(10) ELSE '' END || trim(text, ' ' || chr(10) || chr(9)), ' ' || chr(10) || chr(9)), 1600)) AS given,
    left(trim(text, ' ' || chr(10) || chr(9)), 256) AS asked FROM documents""")
def x31(spark, sf):
    title = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("  "))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(scoring.rerank_text(title, F.col("text"))).alias("given"), scoring.rerank_query(F.col("text")).alias("asked"))


@R.add("x32_json_bytes", """
  SELECT doc_id, md5(j) AS digest, (strlen(j) + 1)::INTEGER AS bytes FROM (
    SELECT doc_id, to_json({'chapterId': doc_id::VARCHAR, 'chapterTitle': lang, 'chapterIndex': doc_id::INTEGER, 'html': text})::VARCHAR AS j FROM documents)""")
def x32(spark, sf):
    j = stored_json(F.col("doc_id").cast("string"), F.col("lang"), F.col("doc_id"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", j.alias("j")).select(
        "doc_id", F.md5("j").alias("digest"), stored_bytes(F.col("j")).alias("bytes"))


@R.add("x33_media", """
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'svg' ELSE 'bin' END AS extension,
    '<figure><img src="data:image/x;base64,' || to_base64(encode(url)) || '" alt="Book cover" loading="eager" decoding="async"/></figure>' AS figure
  FROM pages""")
def x33(spark, sf):
    k = F.col("page_id") % 4
    href = F.when(k == 0, F.lit("img/a.PNG")).when(k == 3, F.lit("img/.hidden")).otherwise(F.lit("img/a"))
    kind = F.when(k == 1, F.lit("image/jpeg")).when(k == 2, F.lit("image/svg+xml")).otherwise(F.lit("image/x"))
    return table(spark, sf, "pages").select(
        "page_id", keys.media_extension(href, kind).alias("extension"),
        html.cover_figure(keys.data_url(F.lit("image/x"), F.col("url").cast("binary"))).alias("figure"))


_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


@R.add("x34_image_references", f"""
  SELECT page_id, array_to_string(list_filter(list_concat({_HREFS}, ['bg/' || page_id || '.png', 'b.jpg']),
    lambda h, i: list_position(list_concat({_HREFS}, ['bg/' || page_id || '.png', 'b.jpg']), h) = i), '|') AS refs FROM pages""")
def x34(spark, sf):
    styled = F.concat(F.lit("<div style=\"background: url('bg/"), F.col("page_id").cast("string"), F.lit(".png')\"></div><style>p{background:URL( b.jpg )}</style>"))
    doc = F.concat(F.replace(F.col("html"), F.lit("<a href="), F.lit("<img src=")), styled)
    return table(spark, sf, "pages").select("page_id", F.array_join(html.image_references(doc), "|").alias("refs"))


@R.add("x35_optional_text", """
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE lang END AS title,
    array_to_string(list_filter([CASE WHEN doc_id % 3 <> 2 THEN 'id' END, CASE WHEN doc_id % 5 = 0 THEN 'index' END], lambda e: e IS NOT NULL), ',') AS errors
  FROM documents""")
def x35(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 1, F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.col("lang")))
    rules = errors_of({"id": F.length(text.strip(raw)) > 0, "index": F.col("doc_id") % 5 > 0})
    return d.select("doc_id", text.optional_text(raw).alias("title"), F.array_join(rules, ",").alias("errors"))


# --- F12 request rules ------------------------------------------------------------------------
@R.add("f12_request_rules", """
  SELECT page_id, array_to_string(list_filter([
    CASE WHEN NOT length(trim(query)) BETWEEN 1 AND 500 THEN 'query' END, CASE WHEN page_id % 7 - 1 < 0 THEN 'offset' END,
    CASE WHEN NOT length(trim(query)) BETWEEN 1 AND 120 THEN 'q' END, CASE WHEN NOT page_id % 13 BETWEEN 1 AND 10 THEN 'limit' END,
    CASE WHEN page_id % 2 = 0 THEN 'fileName' END, CASE WHEN page_id % 3 = 0 THEN 'contentType' END,
    CASE WHEN NOT page_id * 1000000 BETWEEN 1 AND 209715200 THEN 'contentLength' END,
    CASE WHEN NOT length(query) BETWEEN 1 AND 255 THEN 'title' END, CASE WHEN page_id % 5 = 0 THEN 'authors' END], lambda e: e IS NOT NULL), ',') AS errors
  FROM (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '   ' ELSE regexp_extract(html, '<title>(.*?)</title>', 1) || repeat(' word', (page_id % 120)::INTEGER) END AS query FROM pages)""")
def f12(spark, sf):
    pid = F.col("page_id")
    query = F.when(pid % 11 == 0, F.lit("   ")).otherwise(
        F.concat(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.expr("repeat(' word', int(page_id % 120))")))
    kind = F.when(pid % 3 == 0, F.lit("text/html")).otherwise(F.lit("application/epub+zip"))
    name = F.when(pid % 2 == 0, F.concat(F.lit("a/"), pid.cast("string"))).otherwise(F.lit("b.epub"))
    authors = F.when(pid % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A")))
    rules = {
        **search_request_rules(query, pid % 7 - 1), **suggest_request_rules(query, pid % 13),
        **upload_request_rules(name, kind, pid * 1000000), **book_request_rules(query, authors)}
    return table(spark, sf, "pages").select("page_id", F.array_join(errors_of(rules), ",").alias("errors"))
