"""Suggestions over part names, page headings and supplier names."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.trigram import is_prefix, is_word_prefix
from vellum.operators import suggestions as sug
from vellum.plans.suggest import build_index, suggest
from vellum.registry import Registry, table
from vellum.registry.scalars import _SIM, score_sql, trg_list, word_sim_sql
from vellum.session import union_all

R = Registry()


def books(spark, sf):
    """Parts and pages as books; suppliers of a part are its authors."""
    part, pages = table(spark, sf, "part"), table(spark, sf, "pages")
    supplied = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    named = supplied.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    # a part has at most as many suppliers as order lines; names are short
    authors = named.groupBy("l_partkey").agg(F.sort_array(F.collect_set(F.concat(F.lit(" "), F.col("s_name")))).alias("authors"))
    none = F.array().cast("array<string>")
    parts = part.join(authors, part["p_partkey"] == authors["l_partkey"], "left").select(
        F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.coalesce("authors", none).alias("authors"),
        F.when(F.col("p_size") == 7, "DELETED").otherwise("READY").alias("status"))
    headed = pages.select(
        (F.col("page_id") + 1000000).alias("book_id"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        none.alias("authors"), F.lit("READY").alias("status"))
    return union_all(parts, headed)


def asked(spark, sf):
    """Names with a letter left out, two-letter openings, and names holding a wildcard."""
    part, region, nation, customer = (table(spark, sf, n) for n in ("part", "region", "nation", "customer"))
    typo = F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1000))
    queries = (
        part.select(typo.alias("query")).union(part.select(F.upper("p_name"))).union(region.select(F.substring("r_name", 1, 2)))
        .union(nation.select("n_name")).union(nation.select(F.lower(F.substring("n_name", 1, 1)))).union(customer.select("c_mktsegment")).distinct())
    return queries.select("query", F.col("query").alias("query_id"))


_ROWS = """
  books AS (SELECT p_partkey AS book_id, p_name AS title, CASE WHEN p_size = 7 THEN 'DELETED' ELSE 'READY' END AS status FROM part
    UNION ALL SELECT page_id + 1000000, regexp_extract(html, '<title>(.*?)</title>', 1), 'READY' FROM pages),
  sugg AS (SELECT book_id, 'BOOK_TITLE' AS kind, 'book:title' AS source_key, trim(title) AS value, regexp_replace(trim(lower(title)), '\\s+', ' ', 'g') AS nv, 100 AS rank FROM books WHERE trim(title) <> ''
    UNION ALL SELECT DISTINCT l_partkey, 'AUTHOR', 'book:author:' || lower(s_name), s_name, lower(s_name), 80 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""
_ASKED = """
  asked AS (SELECT DISTINCT q AS query_id, lower(q) AS q FROM (SELECT left(p_name, 2) || substring(p_name, 4) AS q FROM part UNION ALL SELECT upper(p_name) FROM part
    UNION ALL SELECT left(r_name, 2) FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT lower(left(n_name, 1)) FROM nation UNION ALL SELECT c_mktsegment FROM customer))"""
_SCORED = f"""
  vals AS (SELECT nv, list_distinct({trg_list('nv')}) AS vs, {trg_list('nv')} AS vl FROM (SELECT DISTINCT nv FROM sugg JOIN books USING (book_id) WHERE status <> 'DELETED')),
  qs AS (SELECT query_id, q, list_distinct({trg_list('q')}) AS qs FROM asked),
  cross_ AS (SELECT * FROM qs, vals),
  -- no extent scores above the share of the query's trigrams that the value holds, so only these pairs can match and be scored
  near AS (SELECT * FROM cross_ WHERE length(q) >= 3 AND list_has_any(qs, vs) AND (nv LIKE q || '%' OR nv LIKE '% ' || q || '%'
    OR {_SIM} >= 0.179 OR len(list_intersect(qs, vs)) >= 0.279 * len(qs))),
  wsim AS ({word_sim_sql('near', 'query_id, nv')}),
  sims AS (SELECT c.*, CASE WHEN length(q) >= 3 THEN {_SIM} ELSE 0 END AS sim, coalesce(ws, 0) AS ws FROM cross_ c LEFT JOIN wsim USING (query_id, nv)),
  scored AS (SELECT query_id, nv, {score_sql('q', 'nv', 'sim', 'ws')} AS score FROM sims
    WHERE nv LIKE q || '%' OR nv LIKE '% ' || q || '%' OR (length(q) >= 3 AND (sim::FLOAT >= 0.18::DOUBLE OR ws::FLOAT >= 0.28::DOUBLE)))"""


def _prepared(spark, sf):
    b = books(spark, sf)
    pool, grams, _ = build_index(sug.suggestion_rows(b), b)
    return sug.prepare_queries(asked(spark, sf)), grams, pool


@R.add("u2_suggestion_rows", f"WITH {_ROWS} SELECT book_id, kind, source_key, value, nv AS normalized_value, rank FROM sugg")
def u2(spark, sf):
    return sug.suggestion_rows(books(spark, sf))


@R.add("a5_distinct_authors", """
  WITH a AS (SELECT c_custkey // 50 AS book_id, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS pos, CASE WHEN c_custkey % 4 = 0 THEN '  ' WHEN c_custkey % 2 = 0 THEN ' ' || upper(c_mktsegment) ELSE lower(c_mktsegment) || ' ' END AS name FROM customer)
  SELECT book_id, pos::INTEGER AS pos, trim(name) AS value, lower(trim(name)) AS normalized_value FROM a WHERE trim(name) <> ''
  QUALIFY row_number() OVER (PARTITION BY book_id, lower(trim(name)) ORDER BY pos) = 1""")
def a5(spark, sf):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(k % 4 == 0, F.lit("  ")).when(k % 2 == 0, F.concat(F.lit(" "), F.upper(seg))).otherwise(F.concat(F.lower(seg), F.lit(" ")))
    listed = table(spark, sf, "customer").select(F.floor(k / 50).alias("book_id"), F.struct("c_custkey", name.alias("n")).alias("s"))
    authors = F.transform(F.sort_array(F.collect_list("s")), lambda s: s["n"]).alias("authors")
    # fifty names at most
    return sug.distinct_authors(listed.groupBy("book_id").agg(authors))


@R.add("j1_live_suggestions", f"WITH {_ROWS} SELECT kind, nv AS normalized_value, count(*)::BIGINT AS n FROM sugg JOIN books USING (book_id) WHERE status <> 'DELETED' GROUP BY ALL")
def j1(spark, sf):
    """Join with the books, deleted ones left out (F3)."""
    b = books(spark, sf)
    return sug.live_suggestions(sug.suggestion_rows(b), b).groupBy("kind", "normalized_value").agg(F.count(F.lit(1)).alias("n"))


@R.add("f3_exclude_deleted", f"WITH {_ROWS} SELECT book_id, title FROM books WHERE status <> 'DELETED'")
def f3(spark, sf):
    return sug.not_deleted(books(spark, sf)).select("book_id", "title")


@R.add("f4_prefix_predicates", """
  SELECT n_name AS q, s_name AS v, lower(s_name) LIKE lower('S_' || left(n_name, 0)) || '%' AS prefix, ('x ' || lower(s_name)) LIKE '% ' || 'su_p' || '%' AS word_prefix,
    lower(n_name) LIKE 'nation_' || (n_nationkey % 3) || '%' AS wild FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def f4(spark, sf):
    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.lower("s_name")
    return j.select(
        F.col("n_name").alias("q"), F.col("s_name").alias("v"), is_prefix(name, F.lit("s_")).alias("prefix"),
        is_word_prefix(F.concat(F.lit("x "), name), F.lit("su_p")).alias("word_prefix"),
        is_prefix(F.lower("n_name"), F.concat(F.lit("nation_"), (F.col("n_nationkey") % 3).cast("string"))).alias("wild"))


@R.add("f5_similarity_predicates", f"WITH {_ROWS}, {_ASKED}, {_SCORED} SELECT query_id, nv AS normalized_value, score FROM scored")
def f5(spark, sf):
    """Every value that matches a query, found through trigrams and word starts."""
    prepared, grams, _ = _prepared(spark, sf)
    return sug.scored_values(prepared, grams)


_POOL = """live AS (SELECT sugg.* FROM sugg JOIN books USING (book_id) WHERE status <> 'DELETED'),
  pool AS (SELECT query_id, book_id, kind, value, nv, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank DESC, length(value), book_id, source_key) - 1 AS pr
    FROM scored JOIN live USING (nv) QUALIFY pr < 64),
  single AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, nv ORDER BY pr) = 1),
  final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr) - 1 AS position FROM single QUALIFY position < 8)"""


@R.add("a6_suggestion_dedup", f"WITH {_ROWS}, {_ASKED}, {_SCORED}, {_POOL} SELECT query_id, nv AS normalized_value, book_id, score FROM single")
def a6(spark, sf):
    from vellum.operators.merges import keep_first
    from vellum.operators.retrieval import top_k

    prepared, grams, pool = _prepared(spark, sf)
    order = [F.desc("score"), F.desc("rank"), F.length("value").asc(), F.asc("book_id"), F.asc("source_key")]
    candidates = top_k(sug.scored_values(prepared, grams).join(pool, "normalized_value"), ["query_id"], order, sug.pool_size(8), "pool_rank")
    return keep_first(candidates, ["query_id", "normalized_value"], [F.col("pool_rank")]).select("query_id", "normalized_value", "book_id", "score")


@R.add("l9_suggestion_pool", f"WITH {_ROWS}, {_ASKED}, {_SCORED}, {_POOL} SELECT query_id, book_id, kind, value, score, pr::INTEGER AS pool_rank FROM pool")
def l9(spark, sf):
    from vellum.operators.retrieval import top_k

    prepared, grams, pool = _prepared(spark, sf)
    order = [F.desc("score"), F.desc("rank"), F.length("value").asc(), F.asc("book_id"), F.asc("source_key")]
    rows = sug.scored_values(prepared, grams).join(pool, "normalized_value")
    return top_k(rows, ["query_id"], order, sug.pool_size(8), "pool_rank").select("query_id", "book_id", "kind", "value", "score", "pool_rank")


@R.add("p5_suggest", f"WITH {_ROWS}, {_ASKED}, {_SCORED}, {_POOL} SELECT query_id, position::INTEGER AS position, book_id, kind, value, score FROM final")
def p5(spark, sf):
    b = books(spark, sf)
    return suggest(asked(spark, sf), sug.suggestion_rows(b), b).select("query_id", "position", "book_id", "kind", "value", "score")


@R.add("p6_sync_suggestions", f"""
  WITH {_ROWS} SELECT book_id, kind, source_key, CASE WHEN book_id % 3 = 0 AND kind = 'BOOK_TITLE' THEN 'New ' || value ELSE value END AS value FROM sugg
  WHERE NOT (book_id % 3 = 0 AND kind = 'AUTHOR')
  UNION ALL SELECT p_partkey, 'SERIES', 'series', p_type FROM part WHERE p_partkey % 2 = 0""")
def p6(spark, sf):
    """Every third book gets a new title and loses its authors; other kinds stay (U4)."""
    b = books(spark, sf)
    old = sug.suggestion_rows(b)
    series = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("book_id"), F.lit("SERIES").alias("kind"), F.lit("series").alias("source_key"), F.col("p_type").alias("value"),
        F.lower("p_type").alias("normalized_value"), F.lit(1).alias("rank"))
    changed = b.filter("book_id % 3 = 0").withColumns(
        {"title": F.concat(F.lit("New "), F.col("title")), "authors": F.array().cast("array<string>")})
    return sug.sync_suggestions(union_all(old, series), changed).select("book_id", "kind", "source_key", "value")
