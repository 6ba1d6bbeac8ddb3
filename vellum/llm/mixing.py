"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.session import broadcast_if_small, stage_table

#: Sources up to which their small table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Slices of a source by the seeded hash; only the slice at the border is taken in part.
SLICES = 4096


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float, share: float = 1.0) -> DataFrame:
    """(key, amount, weight) -> the same with target: weights share out `share` of all amounts, none above max_epochs x its amount.

    Closed form: in ascending order of cap / weight the clamped sources are a
    prefix. The level a source sees is what the ones before it leave, over the
    weights from it on; it is clamped if that level times its weight exceeds
    its cap. One row per source, so the ordered window is over a small table.
    Sources without weight or amount get target 0.
    """
    cap = F.col("amount") * F.lit(float(max_epochs))
    live = (F.col("amount") > 0) & (F.col("weight") > 0)
    ratio = F.when(live, cap / F.col("weight"))
    order = W.orderBy(F.col("__ratio").asc_nulls_first(), F.col("__tie"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    t = (
        sources.withColumn("__live", live).withColumn("__ratio", ratio).withColumn("__tie", F.col("key"))
        .withColumn("__cap", F.when(F.col("__live"), cap).otherwise(0.0))
        .withColumn("__w", F.when(F.col("__live"), F.col("weight").cast("double")).otherwise(0.0))
        .withColumn("__left", F.sum("amount").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__level", F.when(F.col("__live"), F.col("__left") / F.sum("__w").over(after)))
        .withColumn("__free", F.col("__live") & (F.col("__level") * F.col("__w") <= F.col("__cap")))
        # the level at the first source that is not clamped holds for it and all later ones
        .withColumn("__final", F.min(F.when(F.col("__free"), F.struct("__ratio", "__tie", "__level"))).over(everything)["__level"])
    )
    target = F.when(~F.col("__live"), 0.0).when(F.col("__free"), F.least(F.col("__final") * F.col("__w"), F.col("__cap"))).otherwise(F.col("__cap"))
    return t.withColumn("target", target).select(*sources.columns, "target")


def cyclic_weights(sources: DataFrame, period: int = 3) -> DataFrame:
    """(key, amount) -> weight 1, 2, .., period, 1, .. by code point of the key, null last."""
    place = F.row_number().over(W.orderBy(F.col("key").asc_nulls_last()))
    return sources.withColumn("weight", (F.pmod(place - 1, F.lit(period)) + 1).cast("double"))


def mix(docs: DataFrame, weights=cyclic_weights, max_epochs: float = 3.0, seed: int = 17, source: str = "source", text: str = "text",
        doc_id: str = "doc_id", slices: int = SLICES) -> DataFrame:
    """Add size, source_size, target, repetitions (whole) and taken (words, repeats counted) to every document.

    rate = target / source_size says how often the source goes into the mix:
    floor(rate) whole repetitions of every document, and the fraction as one
    more repetition of seeded documents. A seeded hash of the id deals the
    documents of a source over slices; whole slices join the fractional
    repetition while the fraction lasts, and only documents of the slice at the
    border are taken in part (a seeded rounding of words), so the words taken
    meet the target closely even where a source has few or very long documents.
    Nothing is shuffled but sums per (source, slice): a hot source is summed
    inside the tasks first.

    Null and empty texts have size 0 and are taken 0 times; a null source is a
    source of its own, last in order; rows with the same id decide alike; an
    empty table gives an empty result. Columns that carry an added name are
    replaced. `weights` maps (key, amount) to (key, amount, weight).
    """
    added = ["size", "source_size", "target", "repetitions", "taken"]
    rows = docs.drop(*added)
    chance = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.lit("mix"))
    rows = rows.withColumn("size", word_count(F.col(text))).withColumn("__slice", F.pmod(chance, F.lit(slices)))
    # staged, because totals, cuts and the check of their number all read it
    per_slice = stage_table(rows.groupBy(F.col(source).alias("key"), "__slice").agg(F.sum("size").alias("__words")))
    totals = per_slice.groupBy("key").agg(F.sum("__words").alias("amount"))
    plan = (
        water_fill(weights(totals), max_epochs)
        .withColumn("__rate", F.when(F.col("amount") > 0, F.least(F.col("target") / F.col("amount"), F.lit(float(max_epochs)))).otherwise(0.0))
        .withColumn("__whole", F.floor("__rate").cast("long"))
        .withColumn("__part", (F.col("__rate") - F.col("__whole")) * F.col("amount"))
    )
    # words of the fractional repetition that the earlier slices of the source already hold
    run = W.partitionBy("key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    cuts = per_slice.withColumn("__before", F.coalesce(F.sum("__words").over(run), F.lit(0)))
    share = F.when(F.col("__words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__part") - F.col("__before")) / F.col("__words")))).otherwise(0.0)
    known = (
        cuts.join(plan.select(F.col("key").alias("k2"), "amount", "target", "__whole", "__part"), F.col("key").eqNullSafe(F.col("k2")))
        .select("key", F.col("__slice").alias("__at"), "amount", "target", "__whole", share.alias("__share"))
        .groupBy("key").agg(
            F.first("amount").alias("source_size"), F.first("target").alias("target"), F.first("__whole").alias("repetitions"),
            # slices taken whole come first, at most one is cut
            F.max(F.when(F.col("__share") >= 1.0, F.col("__at"))).alias("__last"),
            F.max(F.when((F.col("__share") > 0.0) & (F.col("__share") < 1.0), F.struct("__at", "__share"))).alias("__cut"))
    )
    small = broadcast_if_small(known.withColumnRenamed("key", "__key"), BROADCAST_SOURCES)
    coin = (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.lit("round")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    more = (
        F.when(F.col("__slice") <= F.col("__last"), F.col("size"))
        .when(F.col("__slice") == F.col("__cut.__at"), F.least(F.col("size"), F.floor(F.col("size") * F.col("__cut.__share") + coin).cast("long")))
        .otherwise(F.lit(0).cast("long"))
    )
    return (
        rows.join(small, F.col(source).eqNullSafe(F.col("__key")))
        .withColumn("taken", F.col("size") * F.col("repetitions") + more)
        .select(*[c for c in docs.columns if c not in added], *added)
    )
