"""First/last row per key, upserts, guarded inserts and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from vellum.session import union_all


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the smallest in the given order.

    An aggregate, not a window: rows shrink to one per key on the map side,
    so a key holding a third of all rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the largest in the given order."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def upsert(
    target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str] | None = None,
    insert_only_cols: list[str] | None = None,
) -> DataFrame:
    """Merge by unique key; `insert_only_cols` of existing rows never change.

    `source` holds one row per key. Columns outside both lists keep the old
    value on a match and take the new one on insert.
    """
    if update_cols is None:
        update_cols = [c for c in source.columns if c not in keys and c not in (insert_only_cols or [])]
    old = target.select(*keys, F.struct(*target.columns).alias("_old"))
    new = source.select(*keys, F.struct(*source.columns).alias("_new"))
    joined = old.join(new, keys, "full")

    def pick(name: str) -> Column:
        if name in keys:
            return F.col(name)
        mine = F.col(f"_old.{name}")
        if name not in source.columns:
            return mine.alias(name)
        theirs = F.col(f"_new.{name}")
        if name in update_cols:
            return F.when(F.col("_new").isNotNull(), theirs).otherwise(mine).alias(name)
        return F.when(F.col("_old").isNotNull(), mine).otherwise(theirs).alias(name)

    return joined.select(*[pick(c) for c in target.columns])


def insert_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The incoming rows a unique key lets in: first of each key, not yet stored."""
    return keep_first(incoming, keys, order).join(target.select(*keys), keys, "left_anti")


def flag_inserted(target: DataFrame, incoming: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Every incoming row with `inserted`: true for the one row the key lets in."""
    winners = insert_absent(target, incoming.select(*keys, tie), keys, [F.col(tie)]).withColumn("_in", F.lit(True))
    return incoming.join(winners, [*keys, tie], "left").withColumn(
        "inserted", F.coalesce("_in", F.lit(False))
    ).drop("_in")


def replace_set(target: DataFrame, fresh: DataFrame, owners: DataFrame, owner_keys: list[str]) -> DataFrame:
    """Drop everything the owners hold, then add the fresh rows."""
    kept = target.join(owners.select(*owner_keys).distinct(), owner_keys, "left_anti")
    return union_all(kept, fresh.select(*target.columns))


def unprocessed(events: DataFrame, processed: DataFrame, order: list[Column], key: str = "event_id") -> DataFrame:
    """Events whose id has not been handled: one per id, the first in order."""
    return insert_absent(processed, events, [key], order)


def differences(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found on one side only, with the side."""
    missing = expected.select(*keys).join(stored.select(*keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = stored.select(*keys).join(expected.select(*keys), keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return union_all(missing, extra)
