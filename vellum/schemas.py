"""Declared schemas of stored objects, events and tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STORED_CHAPTER = "chapterId string, chapterTitle string, chapterIndex int, html string"
STORED_BATCH = f"batchIndex int, chapters array<struct<chapterId string, chapterTitle string, chapterIndex int, html string>>"

TOPIC_VERSION = "v1"
# fixed values: topics
RAW_TOPICS = [
    "book.catalog", "book.uploads", "book.chapters.extracted", "book.chapters.vectorized",
    "book.vectorization", "book.assets.extracted",
]


def topic_name(raw: str, version: str = TOPIC_VERSION) -> str:
    if raw not in RAW_TOPICS:
        raise ValueError(f"unknown topic {raw}")
    return f"{version}.{raw}"


@dataclass(frozen=True)
class EventType:
    """One event contract: where it goes and what its payload must hold."""

    name: str
    raw_topic: str
    payload: str
    rules: dict[str, str]
    version: int = 1

    @property
    def topic(self) -> str:
        return topic_name(self.raw_topic)


# rule expressions over the parsed payload `p`
_ID = r"p.bookId rlike '^[0-9]+$' or p.bookId rlike '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'"


def _text(name: str) -> str:
    return f"length(p.{name}) > 0"


def _optional(name: str) -> str:
    return f"p.{name} is null or length(p.{name}) > 0"


def _present(name: str) -> str:
    return f"p.{name} is not null"


def _positive(name: str) -> str:
    return f"p.{name} > 0"


# fixed values: the ten event contracts
EVENT_TYPES = {
    e.name: e
    for e in [
        EventType("BookCreated", "book.catalog",
                  "bookId string, title string, description string, authors array<string>, coverObjectKey string, createdAt string",
                  {"bookId": _ID, "title": _text("title"), "description": _optional("description"),
                   "authors": "p.authors is not null and forall(p.authors, a -> coalesce(length(a) > 0, false))",
                   "coverObjectKey": _optional("coverObjectKey"),
                   "createdAt": r"p.createdAt rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?Z$' and try_to_timestamp(p.createdAt) is not null"}),
        EventType("BookUploaded", "book.uploads", "bookId string, bucket string, objectName string",
                  {"bookId": _ID, "bucket": _present("bucket"), "objectName": _present("objectName")}),
        EventType("ChapterExtracted", "book.chapters.extracted",
                  "bookId string, chapterId string, chapterIndex int, bucket string, s3FilePath string, coverS3FilePath string",
                  {"bookId": _ID, "chapterId": _text("chapterId"), "chapterIndex": _positive("chapterIndex"),
                   "bucket": _present("bucket"), "s3FilePath": _present("s3FilePath"), "coverS3FilePath": _optional("coverS3FilePath")}),
        EventType("ChapterBatchExtracted", "book.chapters.extracted",
                  "bookId string, batchIndex int, bucket string, s3FilePath string, coverS3FilePath string, chaptersCount int, "
                  "chapters array<struct<chapterId string, chapterIndex int>>",
                  {"bookId": _ID, "batchIndex": _positive("batchIndex"), "bucket": _present("bucket"),
                   "s3FilePath": _present("s3FilePath"), "coverS3FilePath": _optional("coverS3FilePath"),
                   "chaptersCount": _positive("chaptersCount"),
                   "chapters": "size(p.chapters) >= 1 and forall(p.chapters, c -> coalesce(length(c.chapterId) > 0 and c.chapterIndex > 0, false))"}),
        EventType("BookCoverExtracted", "book.assets.extracted", "bookId string, bucket string, s3FilePath string, contentType string",
                  {"bookId": _ID, "bucket": _present("bucket"), "s3FilePath": _present("s3FilePath"), "contentType": _text("contentType")}),
        EventType("ChapterVectorized", "book.chapters.vectorized", "bookId string, chapterId string, chunksCount int",
                  {"bookId": _ID, "chapterId": _text("chapterId"), "chunksCount": "p.chunksCount >= 0"}),
        EventType("BookVectorizationStarted", "book.vectorization", "bookId string, expectedChaptersCount int",
                  {"bookId": _ID, "expectedChaptersCount": _positive("expectedChaptersCount")}),
        EventType("BookVectorizationProgress", "book.vectorization", "bookId string, doneChaptersCount int, expectedChaptersCount int",
                  {"bookId": _ID, "doneChaptersCount": "p.doneChaptersCount >= 0", "expectedChaptersCount": _positive("expectedChaptersCount")}),
        EventType("BookVectorizationCompleted", "book.vectorization", "bookId string, doneChaptersCount int, expectedChaptersCount int",
                  {"bookId": _ID, "doneChaptersCount": _positive("doneChaptersCount"), "expectedChaptersCount": _positive("expectedChaptersCount")}),
        EventType("BookVectorizationFailed", "book.vectorization", "bookId string, reason string",
                  {"bookId": _ID, "reason": _text("reason")}),
    ]
}

# every field of every contract; fields of one name have one type
ALL_PAYLOADS = ", ".join(
    dict.fromkeys(
        field
        for event in EVENT_TYPES.values()
        for field in re.split(r",\s+(?![^<]*>)", event.payload)
    )
)

OUTBOX_COLUMNS = [
    "id", "topic", "type", "spec_version", "payload", "aggregate_type", "aggregate_id", "source", "instance",
    "service_version", "correlation_id", "causation_id", "trace_parent", "trace_state", "occurred_at",
]


def rule_columns(event: EventType) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in event.rules.items()}
