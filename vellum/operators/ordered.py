"""Running totals that do not need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut_lineage


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums per key in a total order.

    A window per key would put a hot key into one task. Here the rows are
    range-partitioned by (key, order), so a hot key is spread over several
    tasks; each part is summed alone and shifted by the sums of the parts
    before it. The range layout is checkpointed because both the local sums
    and the shifts must see the same part numbers, also after a lost executor.
    """
    values = {name: f"_v_{i}" for i, name in enumerate(totals)}
    laid_out = cut_lineage(
        df.withColumns({values[name]: c.cast("long") for name, c in totals.items()})
        .repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        laid_out.groupBy("_part", *keys)
        .agg(*[F.sum(v).alias(v) for v in values.values()])
        .select(
            "_part", *keys, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_before") for v in values.values()]
        )
    )
    summed = laid_out.withColumns({v: F.sum(v).over(local) for v in values.values()})
    return summed.join(shifts, ["_part", *keys]).select(
        *df.columns, *[(F.col(v) + F.col(f"{v}_before")).alias(name) for name, v in values.items()]
    )
