"""Envelopes, contracts, projections and the vectorisation state machine."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.functions.rules import ERRORS
from vellum.operators import lifecycle, merges
from vellum.registry import Registry, table
from vellum.session import checkpoint_folder, union_all
from vellum.sources.events import build_events, file_stream, route_outbox
from vellum.sources.folders import names_in
from vellum.streaming.envelope import check_contracts, parse_envelopes, route, split_poison, with_payload, without_tombstones
from vellum.streaming.idlog import IdLog
from vellum.streaming.parked import projected_stream
from vellum.streaming.runners import projection, state_machine_stream

R = Registry()

_K = "(json_extract_string(props, '$.k')::INTEGER)"
_TYPE = "CASE event_type WHEN 'signup' THEN 'BookVectorizationStarted' WHEN 'error' THEN 'BookVectorizationFailed' WHEN 'click' THEN 'BookVectorizationCompleted' WHEN 'purchase' THEN 'BookVectorizationProgress' ELSE 'ChapterVectorized' END"
_KINDS = {"signup": "BookVectorizationStarted", "error": "BookVectorizationFailed", "click": "BookVectorizationCompleted",
          "purchase": "BookVectorizationProgress", "view": "ChapterVectorized"}


def raw(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("book_id"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def outbox(spark, sf):
    """Every event as an outbox row of its contract; k = 0 breaks a rule of most contracts."""
    e = raw(spark, sf)
    kind = F.lit(None).cast("string")
    for name, contract in _KINDS.items():
        kind = F.when(F.col("event_type") == name, F.lit(contract)).otherwise(kind)
    reason = F.when(F.col("event_type") == "error", F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit("e"), F.col("k").cast("string"))))
    count = F.col("event_type").isin("signup", "click", "purchase")
    body = F.to_json(F.struct(
        F.col("book_id").cast("string").alias("bookId"), F.when(count, F.col("k")).alias("expectedChaptersCount"),
        F.when(count & (F.col("event_type") != "signup"), F.col("k")).alias("doneChaptersCount"), reason.alias("reason"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("c"), F.col("k").cast("string"))).alias("chapterId"),
        F.when(F.col("event_type") == "view", F.col("k") - 1).alias("chunksCount")))
    none = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", F.lit("v1.book.chapters.vectorized")).otherwise(F.lit("v1.book.vectorization")).alias("topic"),
        kind.alias("type"), F.when(F.col("k") == 99, 2).otherwise(1).alias("spec_version"), body.alias("payload"), F.lit("book").alias("aggregate_type"),
        F.col("book_id").cast("string").alias("aggregate_id"), F.when(F.col("k") != 5, F.lit("worker")).alias("source"), F.lit("i1").alias("instance"),
        F.lit("1.0.0").alias("service_version"), F.when(F.col("k") == 7, F.lit("not-a-uuid")).alias("correlation_id"), none.alias("causation_id"),
        none.alias("trace_parent"), none.alias("trace_state"), F.col("ts").alias("occurred_at"))


def messages(spark, sf):
    return route_outbox(outbox(spark, sf))


def parsed(spark, sf):
    return check_contracts(parse_envelopes(messages(spark, sf)))


_ENV = f"""e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, {_K} AS k, {_TYPE} AS type FROM events)"""
_BAD = """CASE WHEN k = 7 THEN 'correlation_id' END, CASE WHEN k = 99 THEN 'version'
    WHEN event_type = 'view' AND k - 1 < 0 THEN 'payload.chunksCount' WHEN event_type = 'error' AND k = 0 THEN 'payload.reason'
    WHEN event_type = 'signup' AND k = 0 THEN 'payload.expectedChaptersCount' WHEN event_type = 'purchase' AND k = 0 THEN 'payload.expectedChaptersCount'
    WHEN event_type = 'click' AND k = 0 THEN 'payload.doneChaptersCount,payload.expectedChaptersCount' END"""
_ERR = f"array_to_string(list_filter([{_BAD}], lambda x: x IS NOT NULL), ',')"


@R.add("s8_outbox_routing", f"""WITH {_ENV} SELECT CASE WHEN event_type = 'view' THEN 'v1.book.chapters.vectorized' ELSE 'v1.book.vectorization' END AS topic, user_id::VARCHAR AS key,
    event_id::VARCHAR AS id, type, ms::VARCHAR AS at, 13 AS headers FROM e""")
def s8(spark, sf):
    from vellum.functions.headers import header

    h = F.col("headers")
    return messages(spark, sf).select(
        "topic", F.col("key").cast("string").alias("key"), header(h, "id").alias("id"), header(h, "x-event-type").alias("type"),
        header(h, "x-occurred-at").alias("at"), F.size("headers").alias("headers"))


@R.add("t1_envelopes", f"""WITH {_ENV} SELECT event_id::VARCHAR AS id, type, CASE WHEN k = 99 THEN 2 ELSE 1 END AS version, CASE WHEN k = 5 THEN 'unknown' ELSE 'worker' END AS source,
    user_id::VARCHAR AS aggregate_id, ms AS occurred_ms, CASE WHEN k = 7 THEN 'correlation_id' ELSE '' END AS errors FROM e""")
def t1(spark, sf):
    return parse_envelopes(messages(spark, sf)).select(
        "id", "type", "version", "source", "aggregate_id", F.unix_millis("occurred_at").alias("occurred_ms"), F.array_join(ERRORS, ",").alias("errors"))


@R.add("f9_tombstones", f"SELECT event_id::VARCHAR AS id FROM events WHERE {_K} % 4 <> 0")
def f9(spark, sf):
    from vellum.functions.headers import header

    tagged = messages(spark, sf).withColumn("id", header(F.col("headers"), "id")).join(raw(spark, sf).select(F.col("event_id").cast("string").alias("id"), "k"), "id")
    emptied = tagged.withColumn("value", F.when(F.col("k") % 4 != 0, F.col("value")))
    return without_tombstones(emptied).select("id")


@R.add("f10_poison_split", f"SELECT CASE WHEN user_id % 3 = 0 THEN 'poison' ELSE 'named' END AS side, count(*)::BIGINT AS n FROM events GROUP BY 1")
def f10(spark, sf):
    """Messages of every third book lost their id header."""
    stripped = F.when(F.col("key").cast("string").cast("long") % 3 == 0, F.filter("headers", lambda h: h["key"] != "id")).otherwise(F.col("headers"))
    good, bad = split_poison(messages(spark, sf).withColumn("headers", stripped))
    sides = union_all(good.select(F.lit("named").alias("side")), bad.select(F.lit("poison").alias("side")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@R.add("f11_contract_errors", f"WITH {_ENV} SELECT event_id::VARCHAR AS id, {_ERR} AS errors FROM e")
def f11(spark, sf):
    return parsed(spark, sf).select("id", F.array_join(ERRORS, ",").alias("errors"))


@R.add("t2_build_events", f"""WITH {_ENV} SELECT event_id::VARCHAR AS id, 'v1.book.vectorization' AS topic, '{{"bookId":"' || user_id || '","expectedChaptersCount":' || (k + 1) || '}}' AS payload, user_id::VARCHAR AS aggregate_id FROM e""")
def t2(spark, sf):
    built = build_events(
        raw(spark, sf), "BookVectorizationStarted", {"bookId": F.col("book_id").cast("string"), "expectedChaptersCount": F.col("k") + 1}, F.col("event_id").cast("string"))
    return built.select("id", "topic", "payload", "aggregate_id")


@R.add("t3_routing", f"""WITH {_ENV} SELECT CASE WHEN event_type IN ('signup', 'error') THEN type ELSE 'unhandled' END AS branch, count(*)::BIGINT AS n,
    sum(CASE event_type WHEN 'signup' THEN k WHEN 'error' THEN 1 END)::BIGINT AS total FROM e GROUP BY 1""")
def t3(spark, sf):
    branches = route(parsed(spark, sf), {
        "BookVectorizationStarted": lambda d: d.select(F.col("p.expectedChaptersCount").cast("long").alias("v")),
        "BookVectorizationFailed": lambda d: d.filter(F.col("p.reason").isNotNull()).select(F.lit(1).cast("long").alias("v")),
    }, lambda d: d.select(F.lit(None).cast("long").alias("v")))
    out = None
    for name, rows in branches.items():
        one = rows.select(F.lit(name).alias("branch"), "v")
        out = one if out is None else union_all(out, one)
    return out.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@R.add("t4_idempotent_consumption", f"""WITH {_ENV} SELECT event_id::VARCHAR AS id FROM e WHERE user_id % 5 <> 0""")
def t4(spark, sf):
    """Every message twice, some handled in an earlier run: each is handled once."""
    m = parse_envelopes(messages(spark, sf))
    seen = raw(spark, sf).filter("book_id % 5 = 0").select(F.col("event_id").cast("string").alias("id"))
    return merges.unprocessed(union_all(m, m), seen, [F.col("occurred_at")], key="id").select("id")


# --- counts and projections -------------------------------------------------------------------
@R.add("a1_chapters_done", f"SELECT user_id AS book_id, count(DISTINCT {_K})::BIGINT AS done FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def a1(spark, sf):
    return lifecycle.chapters_done(raw(spark, sf).filter("event_type in ('view', 'click')").withColumnRenamed("k", "chapter_id"))


@R.add("a2_completion", f"""
  WITH d AS (SELECT user_id AS book_id, count(DISTINCT {_K})::BIGINT AS done FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
  x AS (SELECT user_id AS book_id, max({_K}) // 4 + 1 AS expected FROM events WHERE event_type = 'signup' GROUP BY 1)
  SELECT book_id, expected::INTEGER AS expected, coalesce(done, 0)::BIGINT AS done, coalesce(done, 0) >= expected AS completed FROM x LEFT JOIN d USING (book_id)""")
def a2(spark, sf):
    e = raw(spark, sf)
    expected = e.filter("event_type = 'signup'").groupBy("book_id").agg((F.expr("max(k) div 4") + 1).cast("int").alias("expected"))
    return lifecycle.completion(expected, e.filter("event_type in ('view', 'click')").withColumnRenamed("k", "chapter_id"))


@R.add("w8_running_done", f"""
  WITH f AS (SELECT user_id AS book_id, {_K} AS chapter_id, event_id, ts FROM events WHERE event_type IN ('view', 'click', 'purchase')
    QUALIFY row_number() OVER (PARTITION BY user_id, {_K} ORDER BY ts, event_id) = 1)
  SELECT book_id, event_id, count(*) OVER (PARTITION BY book_id ORDER BY ts, event_id)::BIGINT AS done FROM f""")
def w8(spark, sf):
    e = raw(spark, sf).filter("event_type in ('view', 'click', 'purchase')").select("book_id", F.col("k").alias("chapter_id"), "event_id", "ts")
    return lifecycle.running_done(e).select("book_id", "event_id", "done")


_LIFE = f"""l AS (SELECT user_id AS book_id, event_id, epoch_us(ts) AS us, {_K} + 1 AS expected, 'e' || {_K} AS reason,
    CASE event_type WHEN 'signup' THEN 'Started' WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Completed' ELSE 'Progress' END AS type FROM events)"""
_PROJECTED = """SELECT book_id, CASE last_type WHEN 'Completed' THEN 'COMPLETED' WHEN 'Failed' THEN 'FAILED' ELSE 'IN_PROGRESS' END AS status,
    coalesce(expected, 0)::INTEGER AS expected_chapters_count, coalesce(started, first_us) AS started_us,
    CASE WHEN last_type = 'Completed' THEN last_us END AS completed_us, CASE WHEN last_type = 'Failed' THEN last_reason END AS last_error
  FROM (SELECT book_id, last(type ORDER BY us, event_id) AS last_type, last(us ORDER BY us, event_id) AS last_us, last(reason ORDER BY us, event_id) AS last_reason,
    last(expected ORDER BY us, event_id) FILTER (type <> 'Failed') AS expected, max(us) FILTER (type = 'Started') AS started, min(us) AS first_us FROM l GROUP BY book_id)"""


def life(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "Started").when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "click", "Completed").otherwise("Progress")
    return raw(spark, sf).select("book_id", "event_id", "ts", kind.alias("type"), (F.col("k") + 1).alias("expected"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("reason"))


def _micros(rows):
    return rows.select("book_id", "status", "expected_chapters_count", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"), "last_error")


@R.add("t5_projection", f"WITH {_LIFE} {_PROJECTED}")
def t5(spark, sf):
    return _micros(lifecycle.project(lifecycle.projection_partials(life(spark, sf))))


@R.add("w9_last_writer_merge", f"WITH {_LIFE} {_PROJECTED}")
def w9(spark, sf):
    """States of three separate parts of the log merged in the wrong order."""
    e = life(spark, sf)
    parts = [lifecycle.projection_partials(e.filter(F.col("event_id") % 3 == i)) for i in (2, 0, 1)]
    return _micros(lifecycle.project(lifecycle.merge_partials(union_all(union_all(parts[0], parts[1]), parts[2]))))


def steps(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "plan").when(F.col("event_type") == "error", "failed").otherwise("chapter")
    return raw(spark, sf).select(
        "book_id", "event_id", "ts", kind.alias("kind"), F.when(kind == "chapter", F.concat(F.lit("c"), F.col("k").cast("string"))).alias("chapter_id"),
        F.when(kind == "plan", (5 + F.col("k") % 20).cast("int")).alias("expected"))


# per event: chapters so far, plan in force; completion is the first reaching step of a plan's span
_STATE = f"""s AS (SELECT user_id AS book_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'plan' WHEN 'error' THEN 'failed' ELSE 'chapter' END AS kind, {_K} AS k,
    CASE WHEN event_type = 'signup' THEN 5 + {_K} % 20 END AS plan FROM events),
  n AS (SELECT *, kind = 'chapter' AND row_number() OVER (PARTITION BY book_id, kind, CASE WHEN kind = 'chapter' THEN k ELSE -1 END ORDER BY ts, event_id) = 1 AS fresh FROM s),
  r AS (SELECT *, sum(fresh::INTEGER) OVER w AS done, count(plan) OVER w AS epoch, last_value(plan IGNORE NULLS) OVER w AS planned FROM n
    WINDOW w AS (PARTITION BY book_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  c AS (SELECT *, CASE WHEN kind <> 'failed' AND done >= planned THEN row_number() OVER (PARTITION BY book_id, epoch, kind <> 'failed' AND done >= planned ORDER BY ts, event_id) END AS reach FROM r),
  ep AS (SELECT book_id, epoch, max(planned) AS planned, bool_or(coalesce(reach = 1, false)) OR bool_or(kind = 'failed') AS ended FROM c WHERE epoch > 0 GROUP BY ALL),
  o AS (SELECT c.book_id, event_id, 'Started' AS emitted, done, c.planned AS expected FROM c LEFT JOIN ep p ON p.book_id = c.book_id AND p.epoch = c.epoch - 1
      WHERE kind = 'plan' AND (p.book_id IS NULL OR p.ended OR p.planned <> c.planned)
    UNION ALL SELECT book_id, event_id, 'Completed', done, planned FROM c WHERE epoch > 0 AND reach = 1
    UNION ALL SELECT book_id, event_id, 'Progress', done, planned FROM c WHERE epoch > 0 AND kind <> 'failed' AND done < planned AND (kind = 'plan' OR fresh)
    UNION ALL SELECT book_id, event_id, CASE WHEN fresh THEN 'ChapterVectorized' ELSE 'Failed' END, done, NULL FROM c WHERE fresh OR kind = 'failed')
  SELECT book_id, event_id, emitted, done::BIGINT AS done, expected::INTEGER AS expected FROM o"""


@R.add("t6_state_machine", f"WITH {_STATE}")
def t6(spark, sf):
    return lifecycle.state_machine(steps(spark, sf)).select("book_id", "event_id", "emitted", "done", "expected")


def _fresh_folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("t6_state_stream", f"WITH {_STATE}")
def t6_stream(spark, sf):
    """The same machine as a stateful stream over the log in arrival order."""
    from vellum.streaming.stateful import state_stream

    folder = _fresh_folder(spark, "state")
    source = steps(spark, sf)
    # laid out as a keyed topic: all events of a book in one part, in order
    source.repartition("book_id").sortWithinPartitions("ts", "event_id").write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/log")
    query = state_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("done", F.col("done").cast("long"))


@R.add("t6_event_time_stream", f"WITH {_STATE}")
def t6_event_time(spark, sf):
    """The machine in event time over a shuffled log: every micro-batch holds events of all times. A last event long after all others lets the watermark pass them."""
    folder = _fresh_folder(spark, "event-time")
    source = steps(spark, sf)
    source.repartition(6, F.xxhash64("event_id")).write.parquet(f"{folder}/log/a")
    end = source.agg((F.max("ts") + F.expr("interval 1000 days")).alias("ts")).select(
        F.lit(-1).cast("long").alias("book_id"), F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("failed").alias("kind"), F.lit(None).cast("string").alias("chapter_id"), F.lit(None).cast("int").alias("expected"))
    end.coalesce(1).write.parquet(f"{folder}/log/z")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/log/*")
    span = source.agg(F.ceil((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("s")).first().s or 0
    state_machine_stream(stream, f"{span + 1} seconds", folder).awaitTermination()
    return spark.read.parquet(f"{folder}/emitted").drop("batch").withColumn("done", F.col("done").cast("long")).filter("book_id >= 0")


@R.add("t5_projection_stream", f"""
  WITH {_ENV}, l AS (SELECT user_id AS book_id, event_id, epoch_us(ts) // 1000 * 1000 AS us, k AS expected, 'e' || k AS reason,
    CASE event_type WHEN 'signup' THEN 'Started' WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Completed' ELSE 'Progress' END AS type
    FROM events JOIN e USING (event_id, user_id, event_type) WHERE event_type <> 'view' AND {_ERR} = '')
  {_PROJECTED}""")
def t5_stream(spark, sf):
    """Messages delivered twice through a checkpointed stream; states merged on read."""
    folder = _fresh_folder(spark, "projection")
    m = messages(spark, sf)
    union_all(m, m).repartition(3).write.parquet(f"{folder}/messages")

    def partials(fresh):
        parts = None
        for contract in ("Started", "Progress", "Completed", "Failed"):
            d = with_payload(fresh, f"BookVectorization{contract}")
            expected = F.col("p.expectedChaptersCount") if contract != "Failed" else F.lit(None).cast("int")
            reason = F.col("p.reason") if contract == "Failed" else F.lit(None).cast("string")
            one = d.select(F.col("p.bookId").cast("long").alias("book_id"), F.col("id").cast("long").alias("event_id"), F.col("occurred_at").alias("ts"),
                           F.lit(contract).alias("type"), expected.alias("expected"), reason.alias("reason"))
            parts = one if parts is None else union_all(parts, one)
        return lifecycle.projection_partials(parts)

    projection(file_stream(spark, f"{folder}/messages"), partials, folder).awaitTermination()
    states = spark.read.parquet(f"{folder}/states").drop("batch")
    return _micros(lifecycle.project(lifecycle.merge_partials(states)))


# --- read model and chapter rows --------------------------------------------------------------
@R.add("t7_read_model", """
  WITH c AS (SELECT o_custkey AS book_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  v AS (SELECT o_custkey AS book_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
  SELECT c.book_id, 'title ' || c.k AS title, CASE WHEN v.k IS NOT NULL THEN 'cover ' || v.k END AS cover_object_key FROM c LEFT JOIN v USING (book_id)""")
def t7(spark, sf):
    return _read_model(spark, sf)[0].select("book_id", "title", "cover_object_key")


def _read_model(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderstatus")
    n = F.col("event_id").cast("string")
    created = o.filter("o_orderstatus = 'F'").select(
        "book_id", "event_id", "ts", F.concat(F.lit("title "), n).alias("title"), F.lit(None).cast("string").alias("description"),
        F.array(F.lit("a")).alias("authors"), F.lit(None).cast("string").alias("cover_object_key"), F.col("ts").alias("created_at"))
    covers = o.filter("o_orderstatus = 'O'").select("book_id", "event_id", "ts", F.concat(F.lit("cover "), n).alias("s3_file_path"))
    return lifecycle.read_model(created, covers)


@R.add("t7_orphan_covers", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def t7_orphans(spark, sf):
    return _read_model(spark, sf)[1].select("event_id")


def _parked(spark, sf):
    """Covers, chapters and books as three topics, of which that of the books starts last; the log of events that passed."""
    folder = _fresh_folder(spark, "parked")
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    ts = F.col("o_orderdate").cast("timestamp").alias("ts")
    n = F.col("o_orderkey").cast("string")
    book = F.col("o_custkey").alias("book_id")
    body = lambda **fields: F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("body")
    none = F.lit(None).cast("int").alias("attempts")
    covers = o.filter("o_orderstatus = 'O'").select(book, n.alias("event_id"), F.lit("BookCoverExtracted").alias("type"), ts, body(cover=F.concat(F.lit("cover "), n)), none)
    created = o.filter("o_orderstatus = 'F'").select(book, n.alias("event_id"), F.lit("BookCreated").alias("type"), ts, body(title=F.concat(F.lit("title "), n)), none)
    chapters = line.filter("l_linenumber <= 2").join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        book, F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.lit("ChapterExtracted").alias("type"), ts,
        body(chapter=F.concat(F.lit("c"), (F.col("l_orderkey") % 5).cast("string")), index=F.col("l_linenumber").cast("int"), html=F.concat_ws("-", F.lit("h"), "l_orderkey", "l_linenumber")), none)
    # all cores write a topic, and one micro-batch takes as many files as it has
    files = 1
    for k, topic in enumerate((covers, chapters, created)):
        topic.repartition(max(2, spark.sparkContext.defaultParallelism), "event_id").write.parquet(f"{folder}/log/topic={k}")
        files = max(files, sum(n.endswith(".parquet") for n in names_in(spark, f"{folder}/log/topic={k}")))
    stream = spark.readStream.schema(covers.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/log/*")
    # the orders span years, and every topic does
    projected_stream(stream, folder, max_attempts=10, retry_ms=1000 * 86_400_000).awaitTermination()
    return spark.read.schema(covers.schema).parquet(f"{folder}/passed")


@R.add("t7_parked_stream", """
  WITH c AS (SELECT o_custkey AS book_id, max_by(o_orderkey, (o_orderdate, o_orderkey::VARCHAR)) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  v AS (SELECT o_custkey AS book_id, max_by(o_orderkey, (o_orderdate, o_orderkey::VARCHAR)) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
  SELECT c.book_id, 'title ' || c.k AS title, CASE WHEN v.k IS NOT NULL THEN 'cover ' || v.k END AS cover_object_key FROM c LEFT JOIN v USING (book_id)""")
def t7_parked(spark, sf):
    """Read model of streams whose covers come before the books: they wait, and the result is that of the batch projection."""
    p = _parked(spark, sf)
    field = lambda name: F.get_json_object("body", f"$.{name}")
    none = F.lit(None).cast("string")
    created = p.filter("type = 'BookCreated'").select(
        "book_id", "event_id", "ts", field("title").alias("title"), none.alias("description"), F.array(F.lit("a")).alias("authors"), none.alias("cover_object_key"), F.col("ts").alias("created_at"))
    covers = p.filter("type = 'BookCoverExtracted'").select("book_id", "event_id", "ts", field("cover").alias("s3_file_path"))
    return lifecycle.read_model(created, covers)[0].select("book_id", "title", "cover_object_key")


@R.add("t8_parked_stream", """
  SELECT o_custkey AS book_id, 'c' || l_orderkey % 5 AS external_chapter_id, max_by(l_linenumber, (o_orderdate, l_orderkey || '-' || l_linenumber))::INTEGER AS chapter_index,
    min_by('h-' || l_orderkey || '-' || l_linenumber, (o_orderdate, l_orderkey || '-' || l_linenumber)) AS html
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def t8_parked(spark, sf):
    """Chapters that came before their books."""
    field = lambda name: F.get_json_object("body", f"$.{name}")
    e = _parked(spark, sf).filter("type = 'ChapterExtracted'").select(
        "book_id", field("chapter").alias("external_chapter_id"), field("index").cast("int").alias("chapter_index"), F.lit("t").alias("title"), field("html").alias("html"),
        F.lit("b").alias("bucket"), F.lit("k").alias("object_key"), "ts", "event_id")
    return lifecycle.chapter_rows(e).select("book_id", "external_chapter_id", "chapter_index", "html")


@R.add("t4_id_log", """
  SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P') AS handled FROM customer""")
def t4_log(spark, sf):
    """Which ids of a batch the batches before it have handled; each of those was repeated, and all were merged."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderstatus", "o_orderkey")
    log = IdLog(spark, _fresh_folder(spark, "ids"), fan=2)
    for number, batch in enumerate((o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O' and o_orderkey % 2 = 0"), o.filter("o_orderstatus = 'O' and o_orderkey % 2 = 1"))):
        for _ in range(2):
            ids = batch.select("id").distinct()
            log.add(ids.join(log.known(ids, number), "id", "left_anti"), number)
        log.compact()
    asked = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    known = log.known(asked).withColumn("handled", F.lit(True))
    return asked.join(known, "id", "left").select(F.col("id").cast("long").alias("id"), F.coalesce("handled", F.lit(False)).alias("handled"))


@R.add("t8_chapter_projection", """
  SELECT l_orderkey AS book_id, 'c' || l_linenumber AS external_chapter_id, max_by(l_suppkey, (l_shipdate, l_partkey, l_suppkey, l_extendedprice))::INTEGER AS chapter_index,
    'h' || min_by(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS html FROM lineitem GROUP BY ALL""")
def t8(spark, sf):
    e = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("book_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("external_chapter_id"), F.col("l_suppkey").cast("int").alias("chapter_index"),
        F.lit("t").alias("title"), F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("html"), F.lit("b").alias("bucket"), F.lit("k").alias("object_key"),
        F.col("l_shipdate").alias("ts"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("event_id"))
    return lifecycle.chapter_rows(e).select("book_id", "external_chapter_id", "chapter_index", "html")
