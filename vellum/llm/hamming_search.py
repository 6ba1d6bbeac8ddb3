"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments, each with an index from segment value to codes.
After all segments were searched to radius r - 1 and the first j + 1 of them to
radius r, every code up to distance m r + j has been seen: a code further than
that in each segment differs in m r + j + 1 bits. The radius grows, segment by
segment, for those queries whose kth verified distance is not yet covered.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.session import stage_table


def sign_bits(vector: Column, dims: int) -> list[Column]:
    """Words of 64 bits: whether each component is above zero; missing and null components are not."""
    padded = F.concat(vector, F.array_repeat(F.lit(0).cast("float"), F.lit(dims) - F.least(F.size(vector), F.lit(dims))))
    bit = lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.coalesce((x > 0).cast("long"), F.lit(0).cast("long")))
    return [F.aggregate(F.slice(padded, at + 1, min(64, dims - at)), F.lit(0).cast("long"), bit) for at in range(0, dims, 64)]


def segments(dims: int, count: int) -> list[tuple[int, int, int]]:
    """(word, shift, bits) of at least `count` segments of about equal width, none across two words."""
    out = []
    for word in range(-(-dims // 64)):
        bits = min(64, dims - 64 * word)
        own = max(1, -(-count * bits // dims))
        edge = [bits * k // own for k in range(own + 1)]
        out += [(word, a, b - a) for a, b in zip(edge, edge[1:]) if b > a]
    return out


#: What a probe costs, in candidates: it is a row that is made, shuffled and sorted; a candidate is compared inside the join.
PROBE_COST = 25


def expected_distance(dims: int, rows: int, k: int) -> int:
    """Distance within which k of `rows` random codes lie."""
    total, d = 0, 0
    while True:
        total += math.comb(dims, d)
        if d == dims or rows * total >= k * 2**dims:
            return d
        d += 1


def best_segments(dims: int, rows: int, k: int) -> list[tuple[int, int, int]]:
    """The cut with the least expected cost of a query's probes and candidates, as if codes were random.

    Wide segments find fewer candidates but need many more probes, so the count
    of probes jumps where a cut gets wider; weighing probes by what they cost
    keeps it even over the sizes.
    """
    far = expected_distance(dims, rows, k)

    def work(parts: list[tuple[int, int, int]]) -> float:
        radius, last = divmod(far, len(parts))
        probes = [sum(math.comb(b, r) for r in range(radius + (j <= last))) for j, (_, _, b) in enumerate(parts)]
        return sum(p * (PROBE_COST + rows / 2.0**b) for p, (_, _, b) in zip(probes, parts))

    cuts = [segments(dims, m) for m in range(max(1, -(-dims // 24)), max(2, dims // 4 + 1))]
    return min(cuts, key=work)


def _masks(bits: int, radius: int) -> list[int]:
    """All patterns of `radius` set bits."""
    return [sum(1 << b for b in chosen) for chosen in combinations(range(bits), radius)] if radius <= bits else []


def top_k(points: DataFrame, queries: DataFrame, k: int = 10, point_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the k nearest points of every query; ties go to the smaller id.

    Both tables hold ids and vectors; codes are the signs of the components.
    The number of segments is the one with the least expected work.
    Equal codes are one entry of the index, with their k smallest ids (cut
    inside the tasks before anything is shuffled), and equal queries are
    searched once. A code is accepted only from the segment that finds it first
    (fewest differing bits, then the first segment), so nothing has to be made
    distinct afterwards. Every round is staged; its rows are k per open query.

    Null ids and null vectors take no part; with fewer than k points all are
    returned; repeated rows of one id count once.
    """
    dims = points.agg(F.max(F.size(vector)).alias("d"), F.count("*").alias("n")).first()
    n_bits, rows = max(0, dims.d or 0), dims.n
    empty = points.sparkSession.createDataFrame([], "query_id bigint, rank int, neighbor_id bigint, distance int")
    if not n_bits:
        return empty
    parts = best_segments(n_bits, rows, k)
    words = [f"w{i}" for i in range(-(-n_bits // 64))]
    coded = lambda df: df.filter(F.col(vector).isNotNull() & F.col(point_id).isNotNull()).select(
        F.col(point_id).alias("id"), *[c.alias(w) for w, c in zip(words, sign_bits(F.col(vector), n_bits))])
    nth = W.partitionBy(*words).orderBy("id")
    codes = coded(points).distinct().withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= k)
    codes = stage_table(codes.groupBy(*words).agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = stage_table(coded(queries).distinct())
    total = codes.agg(F.sum(F.size("ids"))).first()[0] or 0
    piece = lambda w, s, b: F.shiftrightunsigned(F.col(w), s).bitwiseAND(F.lit((1 << b) - 1))
    index = codes.select("*", F.posexplode(F.array(*[piece(words[w], s, b) for w, s, b in parts])).alias("seg", "value"))
    query_words = [f"q{w}" for w in words]
    open_ = asked.select(*[F.col(w).alias(q) for w, q in zip(words, query_words)]).distinct().withColumn("worst", F.lit(None).cast("int"))
    done = []
    best = None
    # radii that the expected distance goes beyond are searched in all segments at once, then one segment after another;
    # each step knows the bound that the one before has found, so the joins hand on only what can still be among the k
    sure = expected_distance(n_bits, rows, k) // len(parts)
    steps = [([(r, j) for j in range(len(parts))], len(parts) * (r + 1) - 1) for r in range(sure)]
    steps += [([(r, j)], len(parts) * r + j) for r in range(sure, max(b for _, _, b in parts) + 1) for j in range(len(parts))]
    apart = [F.bit_count(piece(words[w], s, b).bitwiseXOR(piece(query_words[w], s, b))) for w, s, b in parts]
    first = F.lit(False)
    for j in range(len(parts)):
        ahead = _all([a > F.col("radius") for a in apart[:j]]) & _all([a >= F.col("radius") for a in apart[j + 1 :]])
        first = first | ((F.col("seg") == j) & ahead)
    distance = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(q))) for w, q in zip(words[1:], query_words[1:])), F.bit_count(F.col(words[0]).bitwiseXOR(F.col(query_words[0]))))
    for searched, covered in steps:
        wanted = [(j, w, s, b, r) for r, j in searched for w, s, b in [parts[j]] if r <= b]
        if wanted:
            probes = F.concat(*[_probes(j, piece(query_words[w], s, b), b, r) for j, w, s, b, r in wanted])
            asked_for = open_.select("*", F.explode(probes).alias("p")).select(*query_words, "worst", "p.seg", "p.value", "p.radius")
            # the planner takes the probes for as few as the queries they are made from, so the join is named
            found = index.join(asked_for.hint("merge"), ["seg", "value"]).filter(first).withColumn("distance", distance.cast("int"))
            found = found.filter(F.col("worst").isNull() | (F.col("distance") <= F.col("worst"))).select(*query_words, "distance", F.explode("ids").alias("id"))
            if best is not None:
                found = best.unionByName(found)
            place = W.partitionBy(*query_words).orderBy("distance", "id")
            best = stage_table(found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(*query_words, "distance", "id"))
        state = open_.drop("worst").join(best.groupBy(*query_words).agg(F.count("*").alias("n"), F.max("distance").alias("far")), query_words, "left")
        state = stage_table(state.withColumn("worst", F.when(F.col("n") >= k, F.col("far"))).select(*query_words, "worst", "n"))
        ready = F.coalesce(F.col("worst") <= covered, F.lit(False)) | (F.coalesce("n", F.lit(0)) >= total)
        done.append(best.join(state.filter(ready), query_words, "left_semi"))
        open_ = state.filter(~ready).drop("n")
        if open_.limit(1).count() == 0:
            break
        best = best.join(open_, query_words, "left_semi")
    else:
        done.append(best)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return (
        asked.select(F.col("id").alias("query_id"), *[F.col(w).alias(q) for w, q in zip(words, query_words)]).join(found, query_words)
        .select("query_id", rank.alias("rank"), F.col("id").alias("neighbor_id"), "distance")
    )


def _probes(segment: int, value: Column, bits: int, radius: int) -> Column:
    """(segment, value, radius) of all values that differ from `value` in `radius` bits."""
    masks = F.expr(f"array({', '.join(f'{m}L' for m in _masks(bits, radius))})")
    return F.transform(masks, lambda m: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(m).alias("value"), F.lit(radius).alias("radius")))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
