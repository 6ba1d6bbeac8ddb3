"""Event log source, outbox sink and their shared message schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.constants import HEADER_NAMES
from vellum.functions.headers import HEADER_TYPE, build_headers
from vellum.schemas import EVENT_TYPES, OUTBOX_COLUMNS, rule_columns

MESSAGE = f"key binary, value binary, topic string, headers {HEADER_TYPE}"


def kafka_stream(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Messages from the earliest offset; the query's checkpoint is the commit."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").option("includeHeaders", True)
        .load().select("key", "value", "topic", "headers")
    )


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Same schema from a folder of parquet files of messages."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def build_events(
    df: DataFrame, event: str, payload: dict[str, Column], event_id: Column | None = None,
    source: str = "app", instance: str = "local", service_version: str = "0.0.0", occurred_at: Column | None = None,
) -> DataFrame:
    """Outbox rows of one event type; an invalid payload stops the job."""
    spec = EVENT_TYPES[event]
    p = F.struct(*[c.alias(name) for name, c in payload.items()])
    typed = df.withColumn("p", F.from_json(F.to_json(p), spec.payload))
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rule_columns(spec).items()])
    )
    body = F.to_json("p", {"ignoreNullFields": "false"})
    checked = F.when(F.size(broken) == 0, body).otherwise(
        F.raise_error(F.concat(F.lit(f"invalid payload for {event}: "), F.array_join(broken, ","))).cast("string")
    )
    none = F.lit(None).cast("string")
    return typed.select(
        (event_id if event_id is not None else F.expr("uuid()")).alias("id"),
        F.lit(spec.topic).alias("topic"), F.lit(spec.name).alias("type"), F.lit(spec.version).alias("spec_version"),
        checked.alias("payload"), F.lit("book").alias("aggregate_type"), F.col("p.bookId").alias("aggregate_id"),
        F.lit(source).alias("source"), F.lit(instance).alias("instance"), F.lit(service_version).alias("service_version"),
        none.alias("correlation_id"), none.alias("causation_id"), none.alias("trace_parent"), none.alias("trace_state"),
        (occurred_at if occurred_at is not None else F.current_timestamp()).alias("occurred_at"),
    )


def event_name_id(*parts: Column) -> Column:
    """Deterministic event id: the same input gives the same id on a retry."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
        F.substring(digest, 17, 4), F.substring(digest, 21, 12),
    )


def route_outbox(outbox: DataFrame) -> DataFrame:
    """Messages of outbox rows: topic by column, key = aggregate id, 13 headers."""
    fields = {
        HEADER_NAMES[name]: (
            F.unix_millis(F.col(name)).cast("string") if name == "occurred_at" else F.col(name).cast("string")
        )
        for name in HEADER_NAMES
    }
    return outbox.select(
        F.col("aggregate_id").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value"), "topic",
        build_headers(fields).alias("headers"),
    )


def append_outbox(rows: DataFrame, path: str) -> None:
    """Append to the outbox table, one folder per topic; no rows, no effect."""
    rows.select(*OUTBOX_COLUMNS).write.mode("append").partitionBy("topic").parquet(path)


def write_kafka(messages: DataFrame, servers: str) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", True).save()
