"""Merkle manifest of a table: three-way hash trees per source and above the sources, with a proof of every row.

Each row is a leaf. The leaves of a source in order of their id, and then the
sources in order of their name, are joined three at a time. The core is a chain
of lag and lead columns over buckets of `WIDTH` consecutive nodes: all rows of a
bucket stay, a node of level l lies on its first row, so its siblings stand at
the fixed offsets of one and two times 3**l; slot and run length mask those of
other runs, and the row of a first child hashes the parent. A bucket never cuts
a run, so a source with a third of all rows is many windows. The tops of the
buckets are the next table, 1 / `WIDTH` as long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.ordered import running_totals
from vellum.session import stage_table

#: Children of a node; levels that one bucket covers, and its nodes.
ARITY, LEVELS = 3, 7
WIDTH = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values on end."""
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 length, colon and value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def tampered(doc_id: Column) -> Column:
    """Whether a row's text is tampered with in the test of the proofs; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame, columns: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(order, key, leaf, changed): key orders the groups bytewise with null first, `changed` is the leaf of a tampered text, else null."""
    name = F.col(group).cast("string")
    key = F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name))
    other = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    hashed = lambda **swap: digest_of(*[field(swap.get(c, F.col(c))) for c in columns])
    return docs.select(F.col(order), key.alias("key"), hashed().alias("leaf"), F.when(tampered(F.col(order)), hashed(**{text: other})).alias("changed"))


def _climb(nodes: DataFrame) -> DataFrame:
    """nodes(key, i, digest, ...) with their bucket, `top` on a bucket's first row, and `steps` to the top of the bucket.

    A step holds the digests before and after a node in its run; levels at
    which the key has a single node are no steps.
    """
    table = nodes.withColumn("bucket", F.floor(F.col("i") / WIDTH).cast("long"))
    place = W.partitionBy("key", "bucket").orderBy("i")
    table = table.withColumns({"held": F.count("*").over(W.partitionBy("key", "bucket")), "node_0": F.col("digest")})
    none = F.lit("")
    slots, firsts = [], []
    for level in range(LEVELS):
        offset = ARITY**level
        slot = F.floor(F.col("i") / offset) % ARITY
        first = F.col("i") % offset == 0
        more = (F.col("bucket") > 0) | (F.col("held") > offset)
        node = F.col(f"node_{level}")
        table = table.withColumns({f"back_{k}": F.lag(node, k * offset).over(place) for k in (1, 2)} | {f"ahead_{k}": F.lead(node, k * offset).over(place) for k in (1, 2)})
        back = F.when(slot == 1, F.col("back_1")).when(slot == 2, F.concat("back_2", "back_1")).otherwise(none)
        next_1, next_2 = F.coalesce("ahead_1", none), F.coalesce("ahead_2", none)
        ahead = F.when(slot == 0, F.concat(next_1, next_2)).when(slot == 1, next_1).otherwise(none)
        step = F.when(first & more, F.struct(back.alias("before"), ahead.alias("after")))
        parent = F.when(more, digest_of(node, next_1, next_2)).otherwise(node)
        table = table.withColumns({f"step_{level}": step, f"node_{level + 1}": F.when(F.col("i") % (ARITY * offset) == 0, parent)})
        slots.append(slot)
        firsts.append(first)
    table = table.withColumn("steps", F.expr("cast(array() as array<struct<before: string, after: string>>)"))
    for level in reversed(range(LEVELS)):
        # the rest of the way is that of the parent, which lies on the row of the first child
        rest = F.col("steps")
        for k in (1, 2):
            table = table.withColumn(f"rest_{k}", F.lag("steps", k * ARITY**level).over(place))
            rest = F.when(slots[level] == k, F.col(f"rest_{k}")).otherwise(rest)
        own = F.when(F.col(f"step_{level}").isNotNull(), F.concat(F.array(f"step_{level}"), rest)).otherwise(rest)
        table = table.withColumn("steps", F.when(firsts[level], own))
    return table.select(*nodes.columns, "bucket", F.col(f"node_{LEVELS}").alias("top"), "steps")


def prove(nodes: DataFrame, above=None) -> DataFrame:
    """nodes(key, i, digest, ...) with `subroot` of their key, `root`, and `steps` all the way up.

    `above` takes (key, digest), one row per key, and returns (key, steps, root)
    of the tree over the keys; without it a key's top is the root.
    """
    climbed = _climb(nodes)
    tops = stage_table(climbed.filter(F.col("i") % WIDTH == 0).select("key", F.col("bucket").alias("i"), F.col("top").alias("digest")))
    if tops.filter("i > 0").limit(1).count():
        upper = prove(tops, above).drop("digest")
    elif above is None:
        upper = tops.select("key", "i", F.expr("cast(array() as array<struct<before: string, after: string>>)").alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    else:
        upper = tops.select("key", "i", F.col("digest").alias("subroot")).join(above(tops.select("key", "digest")), "key")
    upper = stage_table(upper.select("key", F.col("i").alias("bucket"), F.col("steps").alias("more"), "subroot", "root"))
    return climbed.join(upper, ["key", "bucket"]).select(*nodes.columns, "subroot", "root", F.concat("steps", "more").alias("steps"))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with their place `i` within the key, from 0."""
    return running_totals(rows, keys, order, {"i": F.lit(1)}).withColumn("i", F.col("i") - 1)


def _over_sources(subroots: DataFrame) -> DataFrame:
    named = numbered(subroots.select(F.lit("").alias("all"), F.col("key").alias("name"), "digest"), ["all"], ["name"])
    return prove(named.select(F.col("all").alias("key"), "i", "digest", "name")).select(F.col("name").alias("key"), "steps", "root")


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, digest, lambda acc, s: digest_of(s["before"], acc, s["after"]))


def manifest(docs: DataFrame, columns: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, siblings, source) of every row.

    The text is read once and only digests are shuffled. Rows of one id are
    ordered by their leaf; equal rows are leaves of their own. Null ids come
    first and are never tampered with; a null source is a source before all
    others. An empty table has no rows. Other columns play no part.
    """
    read = stage_table(leaves(docs.select(*columns), columns, group, order, text))
    placed = stage_table(numbered(read, ["key"], [order, "leaf"]).withColumnRenamed("leaf", "digest"))
    proved = prove(placed, _over_sources)
    siblings = F.transform("steps", lambda s: F.concat(s["before"], s["after"]))
    root = folded(F.coalesce("changed", "digest"), F.col("steps"))
    return proved.select(
        order, F.col("digest").alias("leaf"), "subroot", "root", F.array_join(siblings, "").alias("siblings"), root.alias("folded_root"), "key",
    ).select(
        order, "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "siblings",
        F.when(F.col("key") != "0", F.expr("substr(key, 2)")).alias(group))
