"""The point table as a log of changes that is merged when it is read.

A change writes the rows of its own points and marks of what they replace,
and never reads or rewrites older files. A row counts while no later change
has marked its chapter or its point. An empty file in `commits` whose name
holds the number and the folder of the change makes it visible as a whole, so
a killed writer leaves the old state, a repeated change replaces itself, and a
reader that pins a version keeps seeing it.
"""

from __future__ import annotations

from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import spread, union_all
from vellum.sources.folders import names_in, put_name, remove

#: Folders that points are spread over by book; a search within books reads those of its books.
BUCKETS = 64
#: Columns of each kind of mark, and those that a row has from its folders.
_MARKS = {"chapters": ("book_id", "chapter_id"), "points": ("point_id",), "flags": ("book_id", "flag")}
_PLACE = [T.StructField("change", T.LongType()), T.StructField("folder", T.StringType())]


class Commit(NamedTuple):
    """A visible change or compacted base and the folder it wrote."""

    number: int
    base: bool
    folder: str


def bucket_of(book: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(book.cast("string")), F.lit(buckets)).cast("int")


class PointStore:
    """Points of one shared folder. Rows hold at least point_id, book_id, chapter_id and is_searchable; each change brings the same columns."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    # --- versions ---------------------------------------------------------------------------
    def commits(self, version: int | None = None) -> list[Commit]:
        """The newest base up to the version and the changes after it; of a repeated change the last one that was finished."""
        found: dict[tuple[int, bool], Commit] = {}
        for name in names_in(self.spark, f"{self.path}/commits"):
            if name[0] != "_":
                number, kind, turn, folder = name.split("-")
                known = found.get((int(number), kind == "base"))
                if known is None or int(turn) > known[0]:
                    found[int(number), kind == "base"] = (int(turn), Commit(int(number), kind == "base", folder))
        seen = sorted((c for _, c in found.values() if version is None or c.number <= version), key=lambda c: (c.number, c.base))
        start = max((c.number for c in seen if c.base), default=-1)
        return [c for c in seen if c.number > start or (c.base and c.number == start)]

    def version(self) -> int:
        """Number of the last change; -1 before the first."""
        return max((c.number for c in self.commits()), default=-1)

    def _publish(self, number: int, base: bool, folder: str) -> None:
        kind = "base" if base else "change"
        turns = [int(n.split("-")[2]) for n in names_in(self.spark, f"{self.path}/commits") if n.startswith(f"{number}-{kind}-")]
        put_name(self.spark, f"{self.path}/commits/{number}-{kind}-{max(turns, default=0) + 1}-{folder}")

    # --- writing ----------------------------------------------------------------------------
    def change(
        self, points: DataFrame | None = None, chapters: DataFrame | None = None, removed: DataFrame | None = None, flags: DataFrame | None = None,
        number: int | None = None,
    ) -> int:
        """Write one change and return its number; a number given again replaces that change.

        `points` replace those of the same id, `chapters(book_id, chapter_id)`
        lose all points they had before, `removed(point_id)` are gone, and
        `flags(book_id, is_searchable)` set the flag of all points that their
        books had before. A repeated point id within one change is the caller's
        error, as it is for any keyed table. Nothing older is read.
        """
        number = self.version() + 1 if number is None else number
        folder = uuid4().hex
        marks = []
        if points is not None:
            rows = points.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
            self._write(rows, number, folder)
            marks.append(("points", points.select("point_id")))
        if removed is not None:
            marks.append(("points", removed.select("point_id")))
        if chapters is not None:
            marks.append(("chapters", chapters.select("book_id", "chapter_id")))
        if flags is not None:
            marks.append(("flags", flags.groupBy("book_id").agg(F.last("is_searchable").alias("flag"))))
        for kind in _MARKS:
            mine = [df for k, df in marks if k == kind]
            if mine:
                union_all(*mine).distinct().write.mode("overwrite").parquet(f"{self.path}/marks/{kind}/change={number}/folder={folder}")
        self._publish(number, False, folder)
        return number

    def _write(self, rows: DataFrame, number: int, folder: str) -> None:
        bucketed = rows.withColumn("bucket", bucket_of(F.col("book_id"), self.buckets))
        # adaptive execution splits large buckets and joins small ones, so a large book is several tasks and a small change few files
        bucketed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/points/change={number}/folder={folder}")

    # --- reading ----------------------------------------------------------------------------
    def read(self, version: int | None = None, books: DataFrame | None = None) -> DataFrame:
        """Points that count at a version, by default at the last; with `books(book_id)` only files of their buckets are read.

        The version is pinned when this is called: later changes, also to the
        same points, do not show. At most `BUCKETS` numbers pass through the driver.
        """
        seen = self.commits(version)
        stored = self._stored("points", seen, T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType()), *_PLACE]))
        marks = {kind: self._stored(f"marks/{kind}", [c for c in seen if not c.base], self._mark_schema(kind)) for kind in _MARKS}
        if books is not None:
            buckets = [r.b for r in books.select(bucket_of(F.col("book_id"), self.buckets).alias("b")).distinct().collect()]
            stored = stored.filter(F.col("bucket").isin(buckets)).join(books.select("book_id").distinct(), "book_id", "left_semi")
        rows = stored.select(*self.schema.names, "change")
        for kind, keys in (("chapters", ["book_id", "chapter_id"]), ("points", ["point_id"])):
            if marks[kind] is not None:
                last = marks[kind].groupBy(*keys).agg(F.max("change").alias("_last"))
                rows = rows.join(last, keys, "left").filter(F.col("_last").isNull() | (F.col("change") >= F.col("_last"))).drop("_last")
        if marks["flags"] is not None:
            # of the flags set after a row was written the last one holds
            last = marks["flags"].groupBy("book_id").agg(F.max_by("flag", "change").alias("_flag"), F.max("change").alias("_last"))
            rows = rows.join(last, "book_id", "left").withColumn(
                "is_searchable", F.when(F.col("_last") > F.col("change"), F.col("_flag")).otherwise(F.col("is_searchable")))
        return rows.select(*self.schema.names)

    def _mark_schema(self, kind: str) -> T.StructType:
        types = {f.name: f.dataType for f in self.schema.fields} | {"flag": T.BooleanType()}
        return T.StructType([*[T.StructField(c, types[c]) for c in _MARKS[kind]], *_PLACE])

    def _stored(self, table: str, seen: list[Commit], schema: T.StructType) -> DataFrame | None:
        """Rows of the named folders only; None (points: an empty table) if there are none."""
        root = f"{self.path}/{table}"
        there = set(names_in(self.spark, root))
        paths = [f"{root}/change={c.number}/folder={c.folder}" for c in seen if f"change={c.number}" in there and f"folder={c.folder}" in names_in(self.spark, f"{root}/change={c.number}")]
        if paths:
            return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)
        return self.spark.createDataFrame([], schema) if table == "points" else None

    # --- upkeep -----------------------------------------------------------------------------
    def compact(self, version: int | None = None) -> int:
        """Write what counts at a version as a new base; changes up to it are no longer read, later ones still apply.

        The base carries the version's number, so marks of later changes count
        against it as against any older row.
        """
        version = self.version() if version is None else version
        folder = uuid4().hex
        self._write(spread(self.read(version)), version, folder)
        self._publish(version, True, folder)
        return version

    def vacuum(self, keep_from: int | None = None) -> int:
        """Remove folders that no version from `keep_from` on (by default the last) reads; versions before it can then no longer be read."""
        last = self.version()
        keep_from = last if keep_from is None else keep_from
        kept = {c.folder for v in range(keep_from, last + 1) for c in self.commits(v)}
        gone = 0
        for table in ("points", *[f"marks/{k}" for k in _MARKS]):
            for change in names_in(self.spark, f"{self.path}/{table}"):
                for folder in names_in(self.spark, f"{self.path}/{table}/{change}"):
                    if folder.startswith("folder=") and folder.removeprefix("folder=") not in kept:
                        remove(self.spark, f"{self.path}/{table}/{change}/{folder}")
                        gone += 1
        for name in names_in(self.spark, f"{self.path}/commits"):
            if name[0] == "_" or name.split("-")[3] not in kept:
                remove(self.spark, f"{self.path}/commits/{name}")
        return gone
