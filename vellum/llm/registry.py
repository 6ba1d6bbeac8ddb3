"""The numbered queries over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.llm import adaptive_scan, bwt_dedup, decontamination, hamming_search, html_extraction, language_id, license_scan, merkle, mixing, ngram_join, periodic_runs, substring_dedup, warc
from vellum.registry import Registry, table
from vellum.session import stage_table

R = Registry()


@R.add("op1_main_text")
def op1(spark, folder):
    pages = table(spark, folder, "pages")
    weights = html_extraction.learn_weights(pages)
    return html_extraction.extract(pages.select("page_id", "url", "html"), weights).select("page_id", "url", "text", "n_chars")


@R.add("op2_warc_segments", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: bin(16 + strpos('0123456789abcdef', hex[i]) - 1)[2:]), 'string_agg', '') AS bits FROM s),
d AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS newest,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    16 * bits[i * 5 + 1]::INT + 8 * bits[i * 5 + 2]::INT + 4 * bits[i * 5 + 3]::INT + 2 * bits[i * 5 + 4]::INT + bits[i * 5 + 5]::INT + 1]), 'string_agg', '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to FROM d
""")
def op2(spark, folder):
    archives = warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html"), "page_id", "url", "html")
    read = warc.read_payloads(archives)
    number = lambda c: F.split(c, ":")[2].cast("long")
    # ids and lengths only, staged so that the archives are read once
    found = stage_table(read.select(
        number(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("own_bytes"), "payload_digest", "record_type",
        number(F.col("refers_to")).alias("refers_to")))
    # a revisit has the length of the response it refers to
    refers = found.filter("record_type = 'revisit'")
    wanted = refers.select(F.col("refers_to").alias("page_id")).distinct()
    lengths = found.filter("record_type = 'response'").join(wanted, "page_id", "left_semi").select(F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("payload_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.filter("record_type = 'response'").withColumnRenamed("own_bytes", "payload_bytes").select(*columns).unionByName(
        refers.join(lengths, "refers_to").select(*columns))


def language_model(spark, docs):
    return language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))


@R.add("op5_language_id")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(spark, docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@R.add("op7_source_mix")
def op7(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _op8_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    said = "' ' || replace(plain, ' ', '  ') || ' '"
    for was, now in license_scan.SPELLINGS:
        said = f"replace({said}, ' {was.replace(' ', '  ')} ', ' {now.replace(' ', '  ')} ')"
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in license_scan.KNOWN)
    return rf"""
WITH known(license_id, text) AS (VALUES {known}),
every AS (SELECT 'd' AS kind, doc_id, NULL AS license_id, text FROM documents UNION ALL SELECT 'k', NULL, license_id, text FROM known),
marked AS (SELECT *, regexp_replace(regexp_replace(lower(text), '{license_scan.ABBREVIATION}', '\1\2 ', 'g'), '{license_scan.GRANT}', chr(1) || '\1', 'g') AS m FROM every),
kept AS (SELECT *, regexp_replace(regexp_replace(m, '(?m){license_scan.NOTICE}', ' ', 'g'), '(?m){license_scan.RESERVED}', ' ', 'g') AS k FROM marked),
plain AS (SELECT *, trim(regexp_replace(k, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS plain FROM kept),
form AS (SELECT *, trim(replace({said}, '  ', ' ')) AS form FROM plain),
dig AS (SELECT *, CASE WHEN form <> '' THEN sha256(form) END AS license_digest FROM form),
ids AS (SELECT license_digest AS d, min(license_id) AS license_id FROM dig WHERE kind = 'k' GROUP BY 1)
SELECT dig.doc_id, dig.license_digest, ids.license_id FROM dig LEFT JOIN ids ON ids.d = dig.license_digest WHERE kind = 'd'
"""


@R.add("op8_license_digest", _op8_sql())
def op8(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.published(spark)).select("doc_id", "license_digest", "license_id")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@R.add("op10_benchmark_leaks", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
""")
def op10(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@R.add("op9_repeated_passages", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT x, min(doc_id) AS first_doc FROM x GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM x JOIN f USING (x) WHERE doc_id > first_doc),
g AS (SELECT doc_id, list(q) AS gone, count(*) AS n_removed FROM h GROUP BY 1),
k AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
kw AS (SELECT doc_id, string_agg(v, ' ' ORDER BY q) AS kept FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS q FROM d) e
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = e.doc_id AND h.q = e.q) GROUP BY 1)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN kw USING (doc_id)
""")
def op9(spark, folder):
    cut = substring_dedup.cut_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@R.add("op4_repeated_bytes")
def op4(spark, folder):
    cut = bwt_dedup.cut_repeated_bytes(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@R.add("op3_jaccard_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.8),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM l WHERE l.a = d.doc_id AND same), d.doc_id)) AS class_id,
  (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS group_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM d
""")
def op3(spark, folder):
    linked = ngram_join.link_documents(table(spark, folder, "documents").select("doc_id", "text"))
    return linked.select("doc_id", "class_id", "group_id", "n_links")


@R.add("op6_hamming_top_k", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
  list_sum(list_transform(range(1, len(q.s) + 1), lambda i: CASE WHEN q.s[i] <> e.s[i] THEN 1 ELSE 0 END))::INT AS distance
  FROM e q JOIN e ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
""")
def op6(spark, folder):
    points = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return hamming_search.top_k(points, points.filter("vec_id % 50 = 0"), 10)


@R.add("op11_periodic_runs")
def op11(spark, folder):
    found = periodic_runs.describe_runs(table(spark, folder, "documents").select("doc_id", "text"), plant=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@R.add("op12_adaptive_scan")
def op12(spark, folder):
    points = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return adaptive_scan.search(points, points.filter("vec_id % 100 = 0"), 10)


def _crc_sql(column: str) -> str:
    """CTEs that end in crc(id, crc): CRC-32 of the decimal digits of an id column of documents."""
    shift = "b"
    for _ in range(8):
        shift = f"(SELECT CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM (SELECT {shift} AS x))"
    return f"""ids AS (SELECT DISTINCT {column} AS id FROM documents WHERE {column} IS NOT NULL),
bytes AS (SELECT b, {shift} AS v FROM (SELECT unnest(range(0, 256)) AS b)),
crcs AS (SELECT id, 0 AS pos, 4294967295::BIGINT AS c FROM ids UNION ALL
  SELECT id, pos + 1, xor(c >> 8, v) FROM crcs JOIN bytes ON b = xor(c & 255, ascii(substr(id::VARCHAR, pos + 1, 1))) WHERE pos < length(id::VARCHAR)),
crc AS (SELECT id, xor(c, 4294967295) AS crc FROM crcs WHERE pos = length(id::VARCHAR))"""


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
_MERKLE = """
WITH RECURSIVE """ + _crc_sql("doc_id") + """,
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('1' || source, '0') AS key, """ + _LEAF.format(_FIELD.format("text")) + """ AS leaf,
  CASE WHEN crc % 2 = 0 THEN """ + _LEAF.format(_FIELD.format("replace(text, chr(10), '')")) + """ END AS changed FROM documents LEFT JOIN crc ON id = doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i FROM d),
low AS (SELECT 0 AS level, key, i, leaf AS h, count(*) OVER (PARTITION BY key) AS n FROM p UNION ALL
  SELECT level + 1, key, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY level, key, i // 3),
sub AS (SELECT key, h, level AS depth, row_number() OVER (ORDER BY encode(key)) - 1 AS i FROM low WHERE n = 1),
high AS (SELECT 0 AS level, i, h, count(*) OVER () AS n FROM sub UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, i // 3),
top AS (SELECT h FROM high WHERE n = 1),
steps_low AS (SELECT a.level, a.key, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM low a JOIN low b ON a.level = b.level AND a.key = b.key AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
steps_high AS (SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM high a JOIN high b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
steps AS (SELECT row, s.level AS pos, before, after FROM p JOIN steps_low s ON s.key = p.key AND s.i = p.i // (3 ** s.level)::BIGINT UNION ALL
  SELECT row, depth + s.level, before, after FROM p JOIN sub USING (key) JOIN steps_high s ON s.i = sub.i // (3 ** s.level)::BIGINT),
fold AS (SELECT row, 0 AS pos, coalesce(changed, leaf) AS h FROM p UNION ALL SELECT row, pos + 1, sha256(before || h || after) FROM fold JOIN steps USING (row, pos)),
ends AS (SELECT row, arg_max(h, pos) AS folded FROM fold GROUP BY 1),
way AS (SELECT row, string_agg(before || after, '' ORDER BY pos) AS siblings FROM steps GROUP BY 1)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded AS folded_root, folded = top.h AS verified
FROM p JOIN sub USING (key) CROSS JOIN top JOIN ends USING (row) LEFT JOIN way USING (row)
"""


@R.add("op13_merkle_manifest", _MERKLE)
def op13(spark, folder):
    return merkle.manifest(table(spark, folder, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
