"""Upload intents against object listings, and book status commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import strip
from vellum.operators.merges import keep_last


def reconcile(intents: DataFrame, objects: DataFrame, now: Column) -> DataFrame:
    """New status, outcome and reason of every upload intent.

    `objects(bucket, object_key, size, content_type, etag)`.
    """
    seen = objects.select(
        "bucket", "object_key", F.col("size").alias("_size"), F.col("content_type").alias("_type"),
        F.col("etag").alias("_etag"), F.lit(True).alias("_there"),
    )
    joined = intents.join(seen, ["bucket", "object_key"], "left")
    pending = F.col("status") == "PENDING"
    expected_size, expected_type = F.col("expected_size_bytes"), F.col("expected_content_type")
    outcome = (
        F.when(F.col("status") == "CONFIRMED", "already_confirmed")
        .when(~pending, "conflict")
        .when(F.col("presigned_expires_at") <= now, "expired")
        .when(F.col("_there").isNull(), "missing")
        .when(expected_size.isNotNull() & (expected_size != F.col("_size")), "size_mismatch")
        .when(expected_type.isNotNull() & F.col("_type").isNotNull() & (expected_type != F.col("_type")), "type_mismatch")
        .when(F.col("_size") <= 0, "empty_object")
        .otherwise("confirmed")
    )
    marked = joined.withColumn("outcome", outcome)
    o = F.col("outcome")
    status = (
        F.when(o == "expired", "EXPIRED").when(o.isin("size_mismatch", "type_mismatch"), "FAILED")
        .when(o == "confirmed", "CONFIRMED").otherwise(F.col("status"))
    )
    reason = (
        F.when(o == "expired", F.lit("Upload URL expired"))
        .when(o == "size_mismatch", F.format_string("Expected size %s bytes, got %s bytes", expected_size.cast("string"), F.col("_size").cast("string")))
        .when(o == "type_mismatch", F.format_string("Expected content type %s, got %s", expected_type, F.col("_type")))
        .when(o == "confirmed", F.lit(None).cast("string"))
        .otherwise(F.col("failed_reason"))
    )
    done = o == "confirmed"
    changed = {
        "status": status,
        "failed_reason": reason,
        "actual_size_bytes": F.when(done, F.col("_size")).otherwise(F.col("actual_size_bytes")),
        "actual_content_type": F.when(done, F.col("_type")).otherwise(F.col("actual_content_type")),
        "etag": F.when(done, F.col("_etag")).otherwise(F.col("etag")),
        "confirmed_at": F.when(done, now).otherwise(F.col("confirmed_at")),
    }
    return marked.withColumns(changed).select(*intents.columns, "outcome")


def apply_commands(books: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ordered status commands: (books after, rejected commands).

    `commands(book_id, seq, action, reason, bucket, object_key)` with actions
    processing, ready, failed, cover, deleted. Deletion absorbs: what follows
    it is rejected, a second deletion is a no-op. Everything is decided by
    per-book aggregates, so a book may have any number of commands.
    """
    actions = ["processing", "ready", "failed", "cover", "deleted"]
    reason, bucket, key = strip(F.col("reason")), strip(F.col("bucket")), strip(F.col("object_key"))
    known = commands.join(books.select("book_id", F.col("status").alias("_was")), "book_id", "left")
    deletion = F.min(F.when(F.col("action") == "deleted", F.col("seq"))).alias("_deleted_at")
    marked = known.join(commands.groupBy("book_id").agg(deletion), "book_id")
    dead = (F.col("_was") == "DELETED") | F.coalesce(F.col("seq") > F.col("_deleted_at"), F.lit(False))
    a = F.col("action")
    error = (
        F.when(F.col("_was").isNull(), "unknown_book")
        .when(~a.isin(*actions), "unknown_action")
        .when(dead & (a != "deleted"), "book_deleted")
        .when((a == "failed") & (F.coalesce(F.length(reason), F.lit(0)) == 0), "reason_required")
        .when((a == "cover") & (F.coalesce(F.length(bucket), F.lit(0)) == 0), "bucket_required")
        .when((a == "cover") & (F.coalesce(F.length(key), F.lit(0)) == 0), "object_key_required")
    )
    judged = marked.withColumns({"_error": error, "_noop": dead & (a == "deleted")})
    rejected = judged.filter(F.col("_error").isNotNull()).select(*commands.columns, F.col("_error").alias("error"))
    valid = judged.filter(F.col("_error").isNull() & ~F.col("_noop"))
    status = F.when(a == "processing", "PROCESSING").when(a == "ready", "READY").when(a == "failed", "FAILED").otherwise("DELETED")
    states = valid.filter(a != "cover").select(
        "book_id", "seq", status.alias("_status"), F.when(a.isin("failed", "deleted"), reason).alias("_reason")
    )
    covers = valid.filter(a == "cover").select("book_id", "seq", bucket.alias("_bucket"), key.alias("_key"))
    last_state = keep_last(states, ["book_id"], [F.col("seq")]).drop("seq").withColumn("_changed", F.lit(True))
    last_cover = keep_last(covers, ["book_id"], [F.col("seq")]).drop("seq")
    out = books.join(last_state, "book_id", "left").join(last_cover, "book_id", "left")
    hit = F.col("_changed").isNotNull()
    return (
        out.withColumns(
            {
                "status": F.when(hit, F.col("_status")).otherwise(F.col("status")),
                "failed_reason": F.when(hit, F.col("_reason")).otherwise(F.col("failed_reason")),
                "cover_bucket": F.coalesce("_bucket", "cover_bucket"),
                "cover_object_key": F.coalesce("_key", "cover_object_key"),
            }
        ).select(*books.columns),
        rejected,
    )
