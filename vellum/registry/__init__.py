"""Named queries over the test tables, each with an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.session import keep_unions_plain

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects (query, SQL) pairs by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    keep_unions_plain(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def everything() -> Registry:
    from vellum.registry import events, ingest, maintenance, scalars, searching, suggesting

    merged = Registry()
    for module in (scalars, searching, suggesting, ingest, maintenance, events):
        for name, fn in module.R.queries.items():
            merged.add(name, module.R.sql.get(name))(fn)
    return merged
