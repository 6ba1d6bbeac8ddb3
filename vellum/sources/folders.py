"""Folders of the shared store through Hadoop's file systems: names, small files, removal."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly inside a folder, sorted; none if it is absent."""
    folder, files = _of(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _of(spark, path)
    return files.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    folder, files = _of(spark, path)
    files.delete(folder, True)


def put_name(spark: SparkSession, path: str) -> None:
    """An empty file that is there as a whole or not at all; what it says is its name."""
    folder, files = _of(spark, path)
    files.mkdirs(folder.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(folder.getParent(), f"_{uuid4().hex}")
    files.create(draft, True).close()
    if not files.rename(draft, folder):
        files.delete(draft, False)
        if not files.exists(folder):
            raise OSError(f"cannot create {path}")
