"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
UNION_CONF = "spark.sql.unionOutputPartitioning"
INPUT_CONF = "spark.vellum.inputPartitions"
_scopes = threading.local()


def local_session(cpus: int | str = "*", app: str = "vellum") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    partitions = str(cpus) if str(cpus).isdigit() else "8"
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        # the test tables are single files of one row group
        .config(INPUT_CONF, partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh one only on a local master, where all tasks see it."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not re.match(r"local($|\[)", context.master):
                raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors reach")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return named or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back as columns.

    For results that several branches use: computed once, pruned by column
    and by partition afterwards, and kept when executors are lost.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{_stages_of(spark)}{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stages_removed(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end; nothing built on them may be read after that."""
    open_ = _scopes.__dict__.setdefault("open", [])
    open_.append([])
    try:
        yield
    finally:
        for path in open_.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _stages_of(spark: SparkSession) -> str:
    return f"stage-{spark.sparkContext.applicationId}-"


def clear_stages(spark: SparkSession) -> int:
    """Remove the staged tables of this application; call it when no result built on them is read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, _stages_of(spark) + "*"))
    for status in found:
        files.delete(status.getPath(), True)
    return len(found)


def keep_unions_plain(spark: SparkSession) -> None:
    try:
        known = spark.conf.get(UNION_CONF)
    except Exception:  # Spark before 4.1 has no such setting and no such unions
        return
    if known != "false":
        spark.conf.set(UNION_CONF, "false")


def union_all(*tables: DataFrame) -> DataFrame:
    """Union by name whose rows are safe to aggregate, join or rank afterwards.

    Spark 4.1 lets a union keep the hash layout of its inputs. When adaptive
    execution then coalesces the inputs differently, equal keys end up in
    different tasks and a following aggregation returns them twice; seen here
    with two ranked lists of one key. The setting is read when a query is
    planned and is only changed where the session knows it.
    """
    keep_unions_plain(tables[0].sparkSession)
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table is small; reads no more than `rows` + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a check of the row count; else a shuffled join."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over as many tasks as the session asks for before CPU-heavy row work.

    Only where the session sets INPUT_CONF, because it knows that its tables
    are few files that cannot be split; else the splits of the input hold.
    """
    asked = df.sparkSession.conf.get(INPUT_CONF, None)
    return df.repartition(int(asked)) if asked else df
