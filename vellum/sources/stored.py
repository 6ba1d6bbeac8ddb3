"""Stored chapters and batches (JSON objects) and cover assets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.rules import apply_policy, validate
from vellum.schemas import STORED_BATCH, STORED_CHAPTER
from vellum.session import stage_table, union_all


def chapter_rules() -> dict:
    return {
        "chapterId": F.length("chapterId") > 0,
        "chapterTitle": F.length("chapterTitle") > 0,
        "chapterIndex": F.col("chapterIndex") > 0,
    }


def _filled(df: DataFrame) -> DataFrame:
    return df.withColumn("html", F.coalesce("html", F.lit("")))


def parse_chapters(lines: DataFrame, on_invalid: str = "fail") -> tuple[DataFrame, DataFrame | None]:
    """Stored-chapter JSON texts in `value`; other columns are kept."""
    parsed = lines.withColumn("_c", F.from_json("value", STORED_CHAPTER))
    rest = [c for c in lines.columns if c != "value"]
    return apply_policy(validate(_filled(parsed.select(*rest, "_c.*")), chapter_rules()), on_invalid)


def parse_batches(lines: DataFrame, on_invalid: str = "fail") -> tuple[DataFrame, DataFrame | None]:
    """Stored-batch JSON texts in `value`, one row per chapter."""
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.withColumn("_b", F.from_json("value", STORED_BATCH))
    spread = parsed.select(*rest, F.col("_b.batchIndex"), F.explode_outer("_b.chapters").alias("_c"))
    rows = _filled(spread.select(*rest, "batchIndex", "_c.*"))
    return apply_policy(validate(rows, {**chapter_rules(), "batchIndex": F.col("batchIndex") > 0}), on_invalid)


def read_chapters(spark: SparkSession, path: str, on_invalid: str = "fail") -> tuple[DataFrame, DataFrame | None]:
    rows = spark.read.schema(STORED_CHAPTER).json(path)
    return apply_policy(validate(_filled(rows), chapter_rules()), on_invalid)


#: Folders that objects are spread over; a folder per book would be too many.
SLOTS = 256


def _replace_slots(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows into their slots; rows of the same keys replace older ones, all others stay."""
    spark = rows.sparkSession
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64("book_id"), F.lit(SLOTS)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        touched = slotted.select("slot").distinct()
        # read before the write replaces the files
        slotted = stage_table(union_all(old.join(F.broadcast(touched), "slot", "left_semi").join(slotted.select(*keys), keys, "left_anti").select(*slotted.columns), slotted))
    slotted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)


def write_objects(objects: DataFrame, path: str) -> None:
    """JSON objects `(book_id, object_name, value)`; an object replaces the one of its name, objects of other books stay."""
    _replace_slots(objects, path, ["book_id", "object_name"])


def write_covers(covers: DataFrame, path: str) -> None:
    """Cover assets `(book_id, object_key, media_type, bytes)`; a book's cover replaces its older one, those of other books stay."""
    _replace_slots(covers, path, ["book_id"])


def attach_covers(books: DataFrame, covers: DataFrame) -> DataFrame:
    """Cover key of each book; a book without a stored cover stays."""
    return books.join(covers.select("book_id", F.col("object_key").alias("cover_object_key")), "book_id", "left")
