"""Stored objects and covers as versioned folders: a write adds its own objects and one commit, and reads nothing older.

The commits, versions, compaction and removal of folders are those of the point
table. An object replaces the one of its key; the last committed write of a key
holds. Keys and versions are compared first, so that objects which were replaced
since are not read as a whole.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources.point_store import _PLACE, BUCKETS, PointStore, bucket_of

OBJECT_KEYS, COVER_KEYS = ("book_id", "object_name"), ("book_id",)


class ObjectStore(PointStore):
    """Keyed objects of one shared folder; each row holds book_id and the other keys."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...] = OBJECT_KEYS, buckets: int = BUCKETS) -> None:
        super().__init__(spark, path, schema, buckets)
        self.keys = list(keys)

    def write(self, objects: DataFrame, number: int | None = None) -> int:
        """Add objects, one of each key, and return the number of the write; a number given again replaces that write.

        Until the commit, which is the last step, readers see the old state.
        """
        number = self.version() + 1 if number is None else number
        folder = uuid4().hex
        self._write(objects.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]), number, folder)
        self._publish(number, False, folder)
        return number

    def read(self, version: int | None = None, books: DataFrame | None = None) -> DataFrame:
        """The objects that hold at a version, by default at the last; with `books(book_id)` only files of their buckets are read."""
        seen = self.commits(version)
        stored = self._stored("points", seen, T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType()), *_PLACE]))
        if books is not None:
            # at most `buckets` numbers pass through the driver
            buckets = [r.b for r in books.select(bucket_of(F.col("book_id"), self.buckets).alias("b")).distinct().collect()]
            stored = stored.filter(F.col("bucket").isin(buckets)).join(books.select("book_id").distinct(), "book_id", "left_semi")
        if len(seen) > 1:
            last = stored.groupBy(*self.keys).agg(F.max("change").alias("change"))
            stored = stored.join(last, [*self.keys, "change"], "left_semi")
        return stored.select(*self.schema.names)


def object_store(spark: SparkSession, path: str) -> ObjectStore:
    """JSON objects of chapters and batches."""
    return ObjectStore(spark, path, T.StructType.fromDDL("book_id bigint, object_name string, value string"))


def cover_store(spark: SparkSession, path: str) -> ObjectStore:
    """The cover of each book."""
    return ObjectStore(spark, path, T.StructType.fromDDL("book_id bigint, object_key string, media_type string, bytes binary"), COVER_KEYS)
