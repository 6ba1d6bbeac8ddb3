"""Point maintenance, upserts, uploads and book commands."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.operators import merges, points, uploads
from vellum.plans.catalogue import assign_ids, create_books, owned
from vellum.registry import Registry, table
from vellum.session import checkpoint_folder, union_all
from vellum.sources.point_store import PointStore

R = Registry()
NOW = "1997-01-01 00:00:00"


def _points(spark, sf):
    """Every order line as a point of the book `part` and the chapter `supplier`."""
    line = table(spark, sf, "lineitem")
    return line.groupBy(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("chapter_id")).agg(F.max("l_orderkey").alias("v")).select(
        F.concat_ws(":", "book_id", "chapter_id").alias("point_id"), "book_id", "chapter_id", "v", F.lit(False).alias("is_searchable"))


_POINTS = "p AS (SELECT l_partkey || ':' || l_suppkey AS point_id, l_partkey AS book_id, l_suppkey AS chapter_id, max(l_orderkey) AS v, false AS is_searchable FROM lineitem GROUP BY ALL)"


@R.add("s9_upsert_points", f"""WITH {_POINTS} SELECT point_id, CASE WHEN book_id % 2 = 0 THEN -v ELSE v END AS v FROM p
  UNION ALL SELECT 'new:' || point_id, v FROM p WHERE book_id % 4 = 0""")
def s9(spark, sf):
    p = _points(spark, sf)
    changed = p.filter("book_id % 2 = 0").withColumn("v", -F.col("v"))
    fresh = p.filter("book_id % 4 = 0").withColumn("point_id", F.concat(F.lit("new:"), F.col("point_id")))
    return points.upsert_points(p, union_all(changed, fresh)).select("point_id", "v")


@R.add("s10_delete_chapters", f"WITH {_POINTS} SELECT point_id FROM p WHERE (book_id, chapter_id) NOT IN (SELECT (p_partkey, p_size) FROM part)")
def s10(spark, sf):
    gone = table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_size").cast("long").alias("chapter_id"))
    return points.delete_chapters(_points(spark, sf), gone).select("point_id")


@R.add("s11_set_searchable", f"WITH {_POINTS} SELECT point_id, p_size <= 25 AS is_searchable FROM p JOIN part ON p_partkey = book_id")
def s11(spark, sf):
    flags = table(spark, sf, "part").filter("p_size < 40").select(F.col("p_partkey").alias("book_id"), (F.col("p_size") <= 25).alias("is_searchable"))
    return points.set_searchable(_points(spark, sf), flags).select("point_id", "is_searchable")


def _store(spark, like):
    return PointStore(spark, f"{checkpoint_folder(spark)}/points-{uuid.uuid4().hex}", like.schema)


@R.add("s9_point_log", f"""WITH {_POINTS},
  a AS (SELECT point_id, book_id, chapter_id, CASE WHEN book_id % 2 = 0 THEN -v ELSE v END AS v FROM p UNION ALL SELECT 'new:' || point_id, book_id, chapter_id, v FROM p WHERE book_id % 4 = 0),
  b AS (SELECT *, false AS fresh FROM a WHERE (book_id, chapter_id) NOT IN (SELECT (p_partkey, p_size) FROM part)
    UNION ALL SELECT point_id, book_id, chapter_id, v + 1, true FROM p WHERE book_id % 3 = 0 AND (book_id, chapter_id) IN (SELECT (p_partkey, p_size) FROM part))
  SELECT point_id, v, NOT fresh AND p_size <= 25 AS is_searchable FROM b JOIN part ON p_partkey = book_id""")
def s9_log(spark, sf):
    """The point table as a log: a first load, an upsert delivered twice, flags, and replaced chapters on top of a compacted base."""
    p = _points(spark, sf)
    store = _store(spark, p)
    store.change(points=p)
    changed = union_all(
        p.filter("book_id % 2 = 0").withColumn("v", -F.col("v")), p.filter("book_id % 4 = 0").withColumn("point_id", F.concat(F.lit("new:"), F.col("point_id"))))
    store.change(points=changed, number=1)
    store.change(points=changed, number=1)
    part = table(spark, sf, "part")
    store.change(flags=part.filter("p_size < 40").select(F.col("p_partkey").alias("book_id"), (F.col("p_size") <= 25).alias("is_searchable")))
    store.compact()
    chapters = part.select(F.col("p_partkey").alias("book_id"), F.col("p_size").cast("long").alias("chapter_id"))
    again = p.join(chapters, ["book_id", "chapter_id"], "left_semi").filter("book_id % 3 = 0").withColumn("v", F.col("v") + 1)
    store.change(points=again.select(*p.columns), chapters=chapters)
    return store.read().select("point_id", "v", "is_searchable")


@R.add("s10_point_log", f"""WITH {_POINTS} SELECT 'pinned' AS version, point_id FROM p UNION ALL
  SELECT 'last', point_id FROM p WHERE (book_id, chapter_id) NOT IN (SELECT (p_partkey, p_size) FROM part) AND v % 3 <> 0""")
def s10_log(spark, sf):
    """Deletes by chapter and by point id as marks; a reader of the version before them still sees every point."""
    p = _points(spark, sf)
    store = _store(spark, p)
    first = store.change(points=p)
    store.change(chapters=table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_size").cast("long").alias("chapter_id")))
    store.change(removed=p.filter("v % 3 = 0").select("point_id"))
    return union_all(store.read(first).select(F.lit("pinned").alias("version"), "point_id"), store.read().select(F.lit("last").alias("version"), "point_id"))


# --- keyed merges -----------------------------------------------------------------------------
@R.add("j8_idempotent_events", """
  SELECT event_id % 4000 AS event_id, min(event_id) AS first FROM events WHERE event_id % 4000 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def j8(spark, sf):
    events = table(spark, sf, "events").select((F.col("event_id") % 4000).alias("event_id"), F.col("event_id").alias("first"))
    processed = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return merges.unprocessed(events, processed, [F.col("first")])


@R.add("j13_guarded_insert", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1
    AND (l_partkey, l_suppkey) NOT IN (SELECT (p_partkey, p_size) FROM part) AS inserted
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)""")
def j13(spark, sf):
    tie = F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("tie")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").distinct().select("*", tie)
    stored = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("l_suppkey"))
    return merges.flag_inserted(stored, rows, ["l_partkey", "l_suppkey"], "tie").drop("tie", "l_extendedprice")


@R.add("j14_upsert", """
  SELECT coalesce(c_custkey, k) AS id, CASE WHEN k IS NOT NULL THEN name ELSE c_name END AS name,
    CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE html END AS html, c_nationkey AS kept
  FROM customer FULL JOIN (SELECT s_suppkey * 20 AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, 'new' AS html FROM supplier) ON k = c_custkey""")
def j14(spark, sf):
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("html"), F.col("c_nationkey").alias("kept"))
    source = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 20).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.lit("new").alias("html"))
    return merges.upsert(target, source, ["id"], update_cols=["name"], insert_only_cols=["html"])


@R.add("u4_replace_set", """
  SELECT l_orderkey, l_partkey AS item FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
  UNION ALL SELECT o_orderkey, -o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0""")
def u4(spark, sf):
    target = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
    owners = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    fresh = owners.filter("o_custkey % 2 = 0").select("l_orderkey", (-F.col("o_custkey")).alias("item"))
    return merges.replace_set(target, fresh, owners, ["l_orderkey"])


# --- uploads ----------------------------------------------------------------------------------
def object_sizes(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("n"))


_RECON = f"""
  s AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1),
  j AS (SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'CANCELED' ELSE 'PENDING' END AS was, o_orderdate <= TIMESTAMP '{NOW}' AS late,
    n, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 200 END AS expected, o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 AS wrong_type FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
  r AS (SELECT *, CASE WHEN was = 'CONFIRMED' THEN 'already_confirmed' WHEN was <> 'PENDING' THEN 'conflict' WHEN late THEN 'expired' WHEN n IS NULL THEN 'missing'
    WHEN expected <> n THEN 'size_mismatch' WHEN wrong_type THEN 'type_mismatch' ELSE 'confirmed' END AS outcome FROM j)"""


def _reconciled(spark, sf):
    k = F.col("o_orderkey")
    base = intents(spark, sf)
    objects = object_sizes(spark, sf).select(
        F.lit("b").alias("bucket"), F.concat(F.lit("k"), k.cast("string")).alias("object_key"), F.col("n").alias("size"),
        F.when(k % 5 == 0, F.lit("text/html")).otherwise(F.lit("application/epub+zip")).alias("content_type"), F.lit("e").alias("etag"))
    return uploads.reconcile(base, objects, F.lit(NOW).cast("timestamp"))


def intents(spark, sf):
    """Orders as upload intents: expiry by order date, expected size by customer."""
    orders = table(spark, sf, "orders")
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    return orders.select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), F.when(k % 10 == 0, F.lit("CONFIRMED")).when(k % 10 == 1, F.lit("CANCELED")).otherwise(F.lit("PENDING")).alias("status"),
        F.lit("b").alias("bucket"), F.concat(F.lit("k"), k.cast("string")).alias("object_key"),
        F.when(k % 7 == 0, none).otherwise(F.lit("application/epub+zip")).alias("expected_content_type"),
        F.when(k % 3 != 0, F.col("o_custkey") % 200).alias("expected_size_bytes"), none.alias("actual_content_type"), F.lit(None).cast("long").alias("actual_size_bytes"),
        none.alias("etag"), F.col("o_orderdate").cast("timestamp").alias("presigned_expires_at"), F.lit(None).cast("timestamp").alias("confirmed_at"), none.alias("failed_reason"))


@R.add("j9_reconcile", f"""WITH {_RECON} SELECT id, outcome, CASE outcome WHEN 'expired' THEN 'EXPIRED' WHEN 'size_mismatch' THEN 'FAILED' WHEN 'type_mismatch' THEN 'FAILED' WHEN 'confirmed' THEN 'CONFIRMED' ELSE was END AS status,
  CASE outcome WHEN 'expired' THEN 'Upload URL expired' WHEN 'size_mismatch' THEN 'Expected size ' || expected || ' bytes, got ' || n || ' bytes'
    WHEN 'type_mismatch' THEN 'Expected content type application/epub+zip, got text/html' END AS failed_reason,
  CASE WHEN outcome = 'confirmed' THEN n END AS actual_size_bytes FROM r""")
def j9(spark, sf):
    return _reconciled(spark, sf).select("id", "outcome", "status", "failed_reason", "actual_size_bytes")


@R.add("p7_reconcile_uploads", f"WITH {_RECON} SELECT outcome, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM r GROUP BY outcome")
def p7(spark, sf):
    return _reconciled(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@R.add("f14_owner_guard", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey = 1")
def f14(spark, sf):
    """Every third request names another user than the owner."""
    i = intents(spark, sf)
    asked = i.select(F.col("id").alias("upload_id"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).alias("user_id"))
    return owned(i, asked).select("id")


_CREATED = """c AS (SELECT o_orderkey AS upload_id, o_custkey AS user_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderkey % 10 = 0)"""
_START = 1796083200000 - 1767225600000  # 2026-12-01 after the id epoch


def _created(spark, sf):
    i = intents(spark, sf)
    k = F.col("id")
    asked = i.select(k.alias("upload_id"), "user_id", F.concat(F.lit("Book "), k.cast("string")).alias("title"), F.lit(None).cast("string").alias("description"), F.array(F.lit("A"), F.lit("a ")).alias("authors"))
    return create_books(asked, i, F.lit("2026-12-01 00:00:00").cast("timestamp"))


@R.add("p8_create_books", f"""WITH {_CREATED} SELECT (((({_START} + i // 4096) << 22) | (i % 4096)))::BIGINT AS book_id, user_id AS owner_id, 'UPLOADED' AS status, 'Book ' || upload_id AS title FROM c""")
def p8(spark, sf):
    return _created(spark, sf)[0].select("book_id", "owner_id", "status", "title")


@R.add("t2_created_events", f"""WITH {_CREATED} SELECT 'v1.book.catalog' AS topic, 'BookCreated' AS type, '{{"bookId":"' || b || '","title":"Book ' || upload_id || '","description":null,"authors":["A","a "],"coverObjectKey":null,"createdAt":"2026-12-01T00:00:00.000Z"}}' AS payload
    FROM (SELECT *, ((({_START} + i // 4096) << 22) | (i % 4096))::BIGINT AS b FROM c)
  UNION ALL SELECT 'v1.book.uploads', 'BookUploaded', '{{"bookId":"' || b || '","bucket":"b","objectName":"k' || upload_id || '"}}' FROM (SELECT *, ((({_START} + i // 4096) << 22) | (i % 4096))::BIGINT AS b FROM c)""")
def t2(spark, sf):
    return _created(spark, sf)[2].select("topic", "type", "payload")


@R.add("x22_bulk_ids", "SELECT event_id, ((1000 + (row_number() OVER (ORDER BY event_id) - 1) // 4096) << 22 | ((row_number() OVER (ORDER BY event_id) - 1) % 4096))::BIGINT AS id FROM events")
def x22_bulk(spark, sf):
    at = F.timestamp_millis(F.lit(1767225600000 + 1000))
    return assign_ids(table(spark, sf, "events").select("event_id"), ["event_id"], at)


# --- book commands ----------------------------------------------------------------------------
_COMMANDS = """cmd AS (SELECT l_orderkey AS book_id, seq, ['processing','ready','failed','cover','deleted'][(seq * 7 + l_orderkey) % 5 + 1] AS action,
    CASE WHEN l_orderkey % 4 = 0 THEN '  ' ELSE ' r' || seq END AS reason FROM (SELECT DISTINCT l_orderkey, l_linenumber AS seq FROM lineitem)),
  dead AS (SELECT book_id, min(seq) AS d FROM cmd WHERE action = 'deleted' GROUP BY 1),
  ok AS (SELECT cmd.* FROM cmd LEFT JOIN dead USING (book_id) JOIN orders ON o_orderkey = book_id WHERE (d IS NULL OR seq <= d) AND o_orderstatus <> 'P' AND NOT (action IN ('failed', 'cover') AND trim(reason) = ''))"""


def _commands(spark, sf):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    books = table(spark, sf, "orders").select(k.alias("book_id"), F.when(F.col("o_orderstatus") == "P", "DELETED").otherwise("UPLOADED").alias("status"),
                                              none.alias("failed_reason"), none.alias("cover_bucket"), none.alias("cover_object_key"))
    step = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("seq")).distinct()
    names = F.array(*map(F.lit, ["processing", "ready", "failed", "cover", "deleted"]))
    reason = F.when(F.col("book_id") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" r"), F.col("seq").cast("string")))
    commands = step.select("book_id", "seq", F.get(names, ((F.col("seq") * 7 + F.col("book_id")) % 5).cast("int")).alias("action"), reason.alias("reason"),
                           F.lit("b").alias("bucket"), reason.alias("object_key"))
    return uploads.apply_commands(books, commands)


@R.add("p9_book_commands", f"""WITH {_COMMANDS},
  st AS (SELECT book_id, arg_max(action, seq) AS a, arg_max(reason, seq) AS r FROM ok WHERE action <> 'cover' GROUP BY 1),
  cv AS (SELECT book_id, arg_max(trim(reason), seq) AS k FROM ok WHERE action = 'cover' GROUP BY 1)
  SELECT o_orderkey AS book_id, CASE WHEN a IS NULL THEN CASE WHEN o_orderstatus = 'P' THEN 'DELETED' ELSE 'UPLOADED' END ELSE upper(a) END AS status,
    CASE WHEN a IN ('failed', 'deleted') THEN trim(r) END AS failed_reason, k AS cover_object_key
  FROM orders LEFT JOIN st ON st.book_id = o_orderkey LEFT JOIN cv ON cv.book_id = o_orderkey""")
def p9(spark, sf):
    return _commands(spark, sf)[0].select("book_id", "status", "failed_reason", "cover_object_key")


@R.add("p9_rejected_commands", f"""WITH {_COMMANDS}
  SELECT cmd.book_id, cmd.seq, CASE WHEN o_orderkey IS NULL THEN 'unknown_book' WHEN (o_orderstatus = 'P' OR seq > d) AND action <> 'deleted' THEN 'book_deleted'
    WHEN action = 'failed' AND trim(reason) = '' THEN 'reason_required' WHEN action = 'cover' AND trim(reason) = '' THEN 'object_key_required' END AS error
  FROM cmd LEFT JOIN dead USING (book_id) LEFT JOIN orders ON o_orderkey = book_id WHERE error IS NOT NULL""")
def p9_rejected(spark, sf):
    return _commands(spark, sf)[1].select("book_id", "seq", "error")
