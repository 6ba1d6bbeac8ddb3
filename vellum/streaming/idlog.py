"""Ids that were handled, for ever: a log of segments by hash, each folder with a Bloom filter.

Every micro-batch adds a segment. Segments are merged like the runs of a
log-structured table, and a segment has as many folders as keep each below
`FOLDER_IDS` ids, so folders grow in number and not in size. A lookup tests the
filters of the folders its ids fall into and reads only folders of which a
filter says "maybe". A segment's name holds the batches it covers and the
number of its folders; it counts once its writer has finished it, and a merged
segment takes the place of those it covers, so a killed writer changes nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources.folders import exists, names_in, remove

#: Ids of a folder, about; bits and probes per id of its filter (one false "maybe" in about 70,000).
FOLDER_IDS, BITS, PROBES = 1 << 17, 24, 12
#: Segments of about one size that are merged into one.
FAN = 8
#: Folders named one by one when files are read; beyond that whole segments are listed and joined.
NAMED_FOLDERS = 4_096


class Segment(NamedTuple):
    """Batches low .. high, its ids and its number of folders."""

    low: int
    high: int
    ids: int
    folders: int

    @property
    def name(self) -> str:
        return f"segment={self.low}-{self.high}-{self.ids}-{self.folders}"


def _hashes(id_: Column) -> list[Column]:
    return [F.xxhash64(id_).alias("h1"), F.xxhash64(id_, F.lit(7)).alias("h2")]


def _folder(h: Column, folders: Column) -> Column:
    return F.pmod(F.shiftright(h, 8), folders).cast("int")


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each id, one row of PROBES per id."""
    a, b = h1.view(np.uint64)[:, None], (h2.view(np.uint64) | np.uint64(1))[:, None]
    return ((a + np.arange(PROBES, dtype=np.uint64) * b) % np.uint64(bits)).astype(np.int64)


def bloom_filter(h1: np.ndarray, h2: np.ndarray) -> bytes:
    """A filter of these ids, of BITS bits for each."""
    held = np.zeros(max(1, -(-len(h1) * BITS // 8)), np.uint8)
    places = _places(h1, h2, 8 * len(held)).ravel()
    np.bitwise_or.at(held, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return held.tobytes()


def maybe_held(bloom: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    held = np.frombuffer(bloom, np.uint8)
    places = _places(h1, h2, 8 * len(held))
    return ((held[places >> 3] >> (places & 7)) & 1).all(axis=1)


def _filter_of(table: pa.Table) -> pa.Table:
    h1, h2 = (table[c].to_numpy() for c in ("h1", "h2"))
    return pa.table({"folder": table["folder"].slice(0, 1), "bloom": pa.array([bloom_filter(h1, h2)], pa.binary())})


def _tested(asked: pa.Table, blooms: pa.Table) -> pa.Table:
    if not len(asked) or not len(blooms):
        return asked.slice(0, 0).select(["segment", "folder", "id"])
    found = maybe_held(blooms["bloom"][0].as_py(), asked["h1"].to_numpy(), asked["h2"].to_numpy())
    return asked.filter(pa.array(found)).select(["segment", "folder", "id"])


_IDS = T.StructType([T.StructField("id", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("folder", T.IntegerType())])
_BLOOMS = T.StructType([T.StructField("bloom", T.BinaryType()), T.StructField("segment", T.StringType()), T.StructField("folder", T.IntegerType())])


class IdLog:
    """The ids handled so far under one folder; a single writer, as the checkpoint of a stream is."""

    def __init__(self, spark: SparkSession, path: str, folder_ids: int = FOLDER_IDS, fan: int = FAN) -> None:
        self.spark, self.folder_ids, self.fan = spark, folder_ids, fan
        self.ids_at, self.blooms_at = path, f"{path}_filters"

    def segments(self, before: int | None = None) -> list[Segment]:
        """Finished segments, of overlapping ones the widest, of all batches or of those before one."""
        found = []
        for name in names_in(self.spark, self.ids_at):
            if name.startswith("segment=") and exists(self.spark, f"{self.blooms_at}/{name}/_SUCCESS"):
                found.append(Segment(*map(int, name.removeprefix("segment=").split("-"))))
        out: list[Segment] = []
        for s in sorted(found, key=lambda s: (s.low - s.high, s.low)):
            if (before is None or s.high < before) and not any(o.low <= s.low and s.high <= o.high for o in out):
                out.append(s)
        return sorted(out)

    def _write(self, ids: DataFrame, low: int, high: int, count: int) -> Segment:
        """Ids first, then their filters; the filters' end mark finishes the segment."""
        segment = Segment(low, high, count, max(1, -(-count // self.folder_ids)))
        hashed = ids.select("id", *_hashes(F.col("id"))).withColumn("folder", _folder(F.col("h1"), F.lit(segment.folders)))
        hashed.select("id", "folder").repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{self.ids_at}/{segment.name}")
        written = self.spark.read.schema(T.StructType([_IDS["id"], _IDS["folder"]])).parquet(f"{self.ids_at}/{segment.name}")
        blooms = written.select("folder", *_hashes(F.col("id"))).groupBy("folder").applyInArrow(_filter_of, "folder int, bloom binary")
        blooms.write.mode("overwrite").partitionBy("folder").parquet(f"{self.blooms_at}/{segment.name}")
        return segment

    def add(self, ids: DataFrame, batch: int) -> None:
        """Log the distinct ids of a batch; a repeated batch takes the place of its former self."""
        count = ids.count()
        for s in self.segments():
            if s.low == s.high == batch:
                self._drop(s)
        if count:
            self._write(ids, batch, batch, count)

    def _drop(self, segment: Segment) -> None:
        # the filters first: without them the segment does not count
        for root in (self.blooms_at, self.ids_at):
            remove(self.spark, f"{root}/{segment.name}")

    def _read(self, root: str, schema: T.StructType, places: DataFrame, segments: list[Segment]) -> DataFrame:
        """Rows of the named folders places(segment, folder) alone, if they are few enough to be named."""
        stored = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{s.name}" for s in segments])
        named = places.limit(NAMED_FOLDERS + 1).collect()
        if len(named) <= NAMED_FOLDERS:
            by: dict[str, list[int]] = {}
            for r in named:
                by.setdefault(r.segment, []).append(r.folder)
            wanted = F.lit(False)
            for name, folders in by.items():
                wanted = wanted | ((F.col("segment") == name) & F.col("folder").isin(folders))
            stored = stored.filter(wanted)
        return stored

    def suspects(self, ids: DataFrame, before: int | None = None) -> tuple[DataFrame, list[Segment]]:
        """(segment, folder, id) of ids(id) that a filter does not rule out."""
        segments = self.segments(before)
        listed = F.array(*[F.struct(F.lit(s.name.removeprefix("segment=")).alias("segment"), F.lit(s.folders).alias("folders")) for s in segments])
        if not segments:
            return self.spark.createDataFrame([], "segment string, folder int, id string"), segments
        asked = ids.select("id", *_hashes(F.col("id")), F.explode(listed).alias("s")).select("s.segment", _folder(F.col("h1"), F.col("s.folders")).alias("folder"), "id", "h1", "h2")
        blooms = self._read(self.blooms_at, _BLOOMS, asked.select("segment", "folder").distinct(), segments)
        key = ["segment", "folder"]
        return asked.groupBy(*key).cogroup(blooms.groupBy(*key)).applyInArrow(_tested, "segment string, folder int, id string"), segments

    def known(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """The distinct ids(id) that the log holds, exactly, of all batches or of those before one."""
        maybe, segments = self.suspects(ids, before)
        if not segments:
            return maybe.select("id")
        # few rows: the duplicates and one in 70,000 of the others
        maybe = maybe.persist()
        places = maybe.select("segment", "folder").distinct()
        return self._read(self.ids_at, _IDS, places, segments).join(maybe, ["segment", "folder", "id"], "left_semi").select("id").distinct()

    def compact(self) -> list[Segment]:
        """Merge neighbouring segments wherever `fan` of about one size have come together; returns what was merged."""
        merged = []
        while True:
            run: list[Segment] = []
            size = lambda s: int(np.log(max(1, s.ids)) / np.log(self.fan))
            for s in self.segments():
                run = [*run, s] if run and size(run[-1]) == size(s) else [s]
                if len(run) == self.fan:
                    break
            else:
                return merged
            root = self.ids_at
            ids = self.spark.read.schema(_IDS).option("basePath", root).parquet(*[f"{root}/{s.name}" for s in run])
            self._write(ids.select("id"), run[0].low, run[-1].high, sum(s.ids for s in run))
            for s in run:
                self._drop(s)
            merged += run
