"""Upload intents, books and their first events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.keys import snowflake
from vellum.operators.ordered import running_totals
from vellum.operators.suggestions import suggestion_rows
from vellum.sources.events import build_events, event_name_id
from vellum.session import union_all


def assign_ids(df: DataFrame, order: list[str], at: Column, datacenter: int = 0, worker: int = 0, out: str = "id") -> DataFrame:
    """Ids in the given order from one start time: 4096 per millisecond.

    The number of a row comes from running totals over range parts, so no
    task sees all rows and a retry gives the same ids.
    """
    numbered = running_totals(df, [], order, {"_n": F.lit(1)})
    n = F.col("_n") - 1
    moment = F.timestamp_millis(F.unix_millis(at) + F.floor(n / 4096))
    return numbered.withColumn(out, snowflake(moment, F.lit(datacenter), F.lit(worker), n % 4096)).drop("_n")


def find_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids; repeated ids count once, null ids never."""
    return rows.join(ids.select(key), key, "left_semi")


def owned(intents: DataFrame, requests: DataFrame) -> DataFrame:
    """Intents asked for by their owner: both id and user must match."""
    return intents.join(requests, (intents["id"] == requests["upload_id"]) & (intents["user_id"] == requests["user_id"]), "left_semi")


def create_books(requests: DataFrame, intents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(books, suggestions, outbox rows, rejected requests).

    `requests(upload_id, user_id, title, description, authors)`; only
    confirmed intents of the same user become books.
    """
    mine = intents.select(
        F.col("id").alias("upload_id"), "user_id", F.col("status").alias("_status"),
        F.col("bucket").alias("_bucket"), F.col("object_key").alias("_object_key"),
    )
    joined = requests.join(mine, ["upload_id", "user_id"], "left")
    error = F.when(F.col("_status").isNull(), "not_found").when(F.col("_status") != "CONFIRMED", "not_confirmed")
    judged = joined.withColumn("error", error)
    rejected = judged.filter(F.col("error").isNotNull()).select("upload_id", "user_id", "error")
    accepted = assign_ids(judged.filter(F.col("error").isNull()), ["upload_id", "user_id"], now, out="book_id")
    none = F.lit(None).cast("string")
    books = accepted.select(
        "book_id", F.col("user_id").alias("owner_id"), F.lit("UPLOADED").alias("status"), "title", "description",
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), none.alias("cover_bucket"),
        none.alias("cover_object_key"), none.alias("failed_reason"), F.col("upload_id").alias("upload_intent_id"),
        now.alias("created_at"), now.alias("updated_at"), "_bucket", "_object_key",
    )
    book = F.col("book_id").cast("string")
    created = build_events(
        books, "BookCreated",
        {"bookId": book, "title": F.col("title"), "description": F.col("description"), "authors": F.col("authors"),
         "coverObjectKey": F.col("cover_object_key"), "createdAt": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")},
        event_name_id(F.lit("BookCreated"), book), occurred_at=now,
    )
    uploaded = build_events(
        books, "BookUploaded", {"bookId": book, "bucket": F.col("_bucket"), "objectName": F.col("_object_key")},
        event_name_id(F.lit("BookUploaded"), book), occurred_at=now,
    )
    stored = books.drop("_bucket", "_object_key")
    return stored, suggestion_rows(stored), union_all(created, uploaded), rejected
