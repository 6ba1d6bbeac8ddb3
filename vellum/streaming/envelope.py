"""Messages to typed envelopes, contract checks and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.constants import HEADER_NAMES
from vellum.functions.headers import header
from vellum.functions.keys import tolerant_timestamp
from vellum.functions.rules import ERRORS, errors_of
from vellum.schemas import ALL_PAYLOADS, EVENT_TYPES, rule_columns

_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def without_tombstones(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("value").isNotNull())


def event_id_of(allow_key: bool = False) -> Column:
    own = header(F.col("headers"), HEADER_NAMES["id"])
    return F.coalesce(own, F.col("key").cast("string")) if allow_key else own


def split_poison(messages: DataFrame, allow_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages with an `event_id`, dead letters without one)."""
    named = messages.withColumn("event_id", event_id_of(allow_key))
    empty = F.coalesce(F.length("event_id"), F.lit(0)) == 0
    return named.filter(~empty), named.filter(empty).drop("event_id").withColumn("error", F.lit("missing event id"))


def parse_envelopes(messages: DataFrame) -> DataFrame:
    """Typed envelope columns with defaults, and `_errors` of the header rules."""
    h = {name: header(F.col("headers"), key) for name, key in HEADER_NAMES.items()}
    key = F.col("key").cast("string")
    own_id = F.when(F.length(h["id"]) > 0, h["id"])
    version = F.when(h["spec_version"].isNull(), F.lit(1)).otherwise(h["spec_version"].try_cast("int"))
    typed = messages.select(
        F.coalesce(own_id, key).alias("id"), h["type"].alias("type"), version.alias("version"),
        F.coalesce(F.col("value").cast("string"), F.lit("{}")).alias("payload"),
        F.coalesce(h["source"], F.lit("unknown")).alias("source"), h["instance"].alias("instance"),
        h["service_version"].alias("service_version"), h["aggregate_id"].alias("aggregate_id"),
        h["aggregate_type"].alias("aggregate_type"), h["correlation_id"].alias("correlation_id"),
        h["causation_id"].alias("causation_id"), h["trace_parent"].alias("trace_parent"),
        h["trace_state"].alias("trace_state"), tolerant_timestamp(h["occurred_at"]).alias("occurred_at"),
        *[c for c in messages.columns if c not in ("key", "value", "headers", "event_id")],
    )
    optional_uuid = {n: F.col(n).isNull() | F.col(n).rlike(_UUID) for n in ("correlation_id", "causation_id")}
    present = {n: F.col(n).isNotNull() for n in ("id", "instance", "service_version", "aggregate_id", "aggregate_type", "occurred_at")}
    return typed.withColumn(
        ERRORS, errors_of({"type": F.length("type") > 0, "version": F.col("version") >= 1, **present, **optional_uuid})
    )


def check_contracts(envelopes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Adds contract violations to `_errors`: type, version and payload rules.

    The payload is parsed once, by the union of all contracts' fields.
    """
    parsed = envelopes.withColumn("p", F.from_json("payload", ALL_PAYLOADS))
    found = F.array(F.lit("unknown_type"))
    for name in types or EVENT_TYPES:
        spec = EVENT_TYPES[name]
        broken = errors_of({f"payload.{field}": ok for field, ok in rule_columns(spec).items()})
        judged = F.when(F.col("version") == spec.version, broken).otherwise(F.array(F.lit("version")))
        found = F.when(F.col("type") == name, judged).otherwise(found)
    before = F.coalesce(F.col(ERRORS), F.array().cast("array<string>"))
    return parsed.withColumn(ERRORS, F.concat(before, found)).drop("p")


def with_payload(envelopes: DataFrame, event: str) -> DataFrame:
    """Envelopes of one type with the payload parsed into `p`."""
    return envelopes.filter(F.col("type") == event).withColumn("p", F.from_json("payload", EVENT_TYPES[event].payload))


def route(envelopes: DataFrame, handlers: dict, default=None) -> dict[str, DataFrame]:
    """Apply one handler per event type to its rows; the rest is `unhandled`.

    Inside foreachBatch the batch is read once: cache it before routing.
    """
    out = {}
    for event, handler in handlers.items():
        if event not in EVENT_TYPES:
            raise ValueError(f"unknown event type {event}")
        out[event] = handler(with_payload(envelopes, event))
    rest = envelopes.filter(F.col("type").isNull() | ~F.col("type").isin(*handlers))
    out["unhandled"] = default(rest) if default else rest
    return out
