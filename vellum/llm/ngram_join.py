"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word n-grams. Equal sets are one class. Bands of MinHash
values propose which classes may be linked; inside the proposed neighbourhoods
MinHash values are compared a few at a time, a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold falls below a
tolerance, and what is left is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.textbytes import Prefix, combine, flat, mix, starts_inside, words
from vellum.session import stage_table

#: Words of an n-gram and similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Probability at most with which the bands miss a pair at the threshold; rows and number of bands at most, as long as that allows it.
MISS, ROWS, BANDS = 1.3e-7, 5, 128
#: MinHash values compared at once, how many at most, and the posterior below which a pair is dropped.
STEP, STEPS, TOLERANCE = 16, 8, 1e-7
#: Classes of one neighbourhood that are compared in one task; larger ones are compared block by block.
BLOCK = 512
_rng = np.random.default_rng(91)
_FACTOR = (_rng.integers(0, 1 << 31, 200, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, len(_FACTOR), dtype=np.uint32)


def band_shape(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands miss a pair at the threshold with probability (1 - t^rows)^bands <= MISS; 40 bands of 5 for 0.8."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("a threshold lies above 0 and is at most 1")
    for rows in range(ROWS, 0, -1):
        bands = 1 if threshold == 1.0 else ceil(log(MISS) / log1p(-(threshold**rows)))
        if bands <= BANDS or rows == 1:
            return bands, rows
    raise AssertionError


def factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of the first `count` hash functions; more than the fixed table holds come from a second stream."""
    if count <= len(_FACTOR):
        return _FACTOR[:count], _SHIFT[:count]
    more = np.random.default_rng(92).integers(0, 1 << 32, (count - len(_FACTOR), 2), dtype=np.uint32)
    return np.concatenate([_FACTOR, more[:, 0] | np.uint32(1)]), np.concatenate([_SHIFT, more[:, 1]])


def ngram_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram fingerprints of each text; a shorter text is one n-gram of all its words, one without words has none."""
    data, offsets = flat(texts)
    start, end, first = words(data, offsets)
    hashes = Prefix(data).of(start, end)
    whole, at = combine(hashes, n), starts_inside(first, n)
    cut = np.searchsorted(at, first)
    out = []
    for k in range(len(offsets) - 1):
        a, b = int(first[k]), int(first[k + 1])
        out.append(np.unique(whole[at[cut[k] : cut[k + 1]]]) if b - a >= n else combine(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def minhash(grams: np.ndarray, count: int) -> np.ndarray:
    """The first `count` MinHash values of a set."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    factor, shift = factors(count)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[at : at + 2048, None] * factor + shift).min(axis=0), out=out)
    return out


def least_matches(threshold: float, tolerance: float, step: int = STEP, steps: int = STEPS) -> list[int]:
    """Fewest matches of the first step, 2 step, .. values that keep a pair.

    With a flat prior the posterior after m of n matches is Beta(m + 1,
    n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, step * steps + 1, step):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float, tolerance: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j linked with it) for i in `left` and j in `right`, or for i < j in `left`."""
    least = least_matches(threshold, tolerance)
    signs = np.stack([minhash(s, STEP * STEPS) for s in sets])
    sizes = np.array([len(s) for s in sets])
    value = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bound = np.concatenate([[0], np.cumsum(sizes)])
    mask = np.zeros(int(value.max()) + 1 if len(value) else 1, bool)
    for turn, i in enumerate(left):
        alive = left[turn + 1 :] if right is None else right
        # sizes alone bound the similarity
        alive = alive[np.minimum(sizes[alive], sizes[i]) >= threshold * np.maximum(sizes[alive], sizes[i]) - 1e-9]
        matches = np.zeros(len(alive), np.int64)
        for step, need in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            matches += (signs[alive, part] == signs[i, part]).sum(axis=1)
            alive, matches = alive[matches >= need], matches[matches >= need]
            if not len(alive):
                break
        if not len(alive):
            continue
        own = value[bound[i] : bound[i + 1]]
        mask[own] = True
        shared = np.array([np.count_nonzero(mask[value[bound[j] : bound[j + 1]]]) for j in alive])
        mask[own] = False
        yield int(i), alive[shared / (sizes[i] + sizes[alive] - shared) >= threshold]


def _class_rows(n: int, threshold: float):
    count, rows = band_shape(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                node, keys = [], []
                for grams in ngram_sets(part.column(1), n):
                    if not len(grams):
                        node.append(None)
                        keys.append(None)
                        continue
                    node.append(int(mix(np.bitwise_xor.reduce(mix(grams), keepdims=True) + grams.sum(keepdims=True) + np.uint64(len(grams))).view(np.int64)[0]))
                    bands = minhash(grams, count * rows).astype(np.uint64).reshape(count, rows)
                    keys.append(combine_rows(bands).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(node, pa.int64()), pa.array(keys, pa.binary())], names=["row", "doc_id", "node", "keys"])

    return run


def combine_rows(bands: np.ndarray) -> np.ndarray:
    """One key per band, different between bands."""
    h = np.arange(1, len(bands) + 1, dtype=np.uint64) << np.uint64(40)
    for j in range(bands.shape[1]):
        h = mix(h ^ bands[:, j])
    return h


def _proposals(buckets: int, bands: int):
    """Within a batch: members of a band key hang on the smallest one; only that one goes on to the key's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column(0), np.int64)
            if not len(node):
                continue
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            owner = np.repeat(node, bands)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            hub = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
            a, b = _distinct(hub[~new], owner[~new])
            yield pa.RecordBatch.from_pylist([{"bucket": None, "a": a.tobytes(), "b": b.tobytes()}] if len(a) else [], _PACKED)
            key, owner = key[new], owner[new]
            at = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.diff(at[order])) + 1
            for part in np.split(order, cut):
                yield pa.RecordBatch.from_pylist([{"bucket": int(at[part[0]]), "a": key[part].tobytes(), "b": owner[part].tobytes()}], _PACKED)

    return run


_PACKED = pa.schema([("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _hubs(table: pa.Table) -> pa.Table:
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()])
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("b").to_pylist()])
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    hub = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    a, b = _distinct(hub[~new], owner[~new])
    return pa.table({"a": a, "b": b}, schema=_EDGES)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], schema=_EDGES)


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD,
                   tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, node, component, class_id, group_id, n_links) for every row.

    class_id: smallest id with the same set of n-grams. n_links: rows linked
    with this one, its copies included, at Jaccard similarity `threshold` or
    more. group_id: smallest id among all rows it is connected with by links.
    `row` numbers the rows of `docs` as monotonically_increasing_id() does;
    `node` is the fingerprint of the set (null without words) and `component`
    that of the group.

    Bands follow from the threshold (band_shape), so any of them finds its
    pairs; low ones propose large neighbourhoods.

    Copies are one class and are never paired. A band key passes a task's batch
    once, as a star around its smallest class; stars are joined to
    neighbourhoods, which hold every pair the bands propose. Neighbourhoods up
    to `block` classes are compared in one task, larger ones block against
    block in tasks of their own; a task returns counts and a spanning forest,
    at most two rows per class, never pairs. Comparing a neighbourhood takes
    time in the square of its different texts.

    Null and empty texts are linked with nothing and are their own class. Rows
    without an id take part; ids of classes and groups are over the ids there
    are. Other columns are ignored.
    """
    numbered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    keys = stage_table(numbered.mapInArrow(_class_rows(n, threshold), "row bigint, doc_id bigint, node bigint, keys binary"))
    classes = stage_table(keys.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("class_id"), F.min("row").alias("shown"), F.count("*").alias("copies"), F.min("keys").alias("keys")))
    many = classes.count()
    bands, _ = band_shape(threshold)
    buckets = max(1, -(-many * bands // 1_000_000))
    packed = stage_table(classes.select("node", "keys").mapInArrow(_proposals(buckets, bands), "bucket bigint, a binary, b binary"))
    near = packed.filter("bucket is null").mapInArrow(_unpacked, "a bigint, b bigint")
    far = packed.filter("bucket is not null").groupBy("bucket").applyInArrow(_hubs, "a bigint, b bigint")
    around = stage_table(components(near.unionByName(far)).join(classes.select("node", "shown", "copies"), "node"))

    # neighbourhoods: small ones share tasks, large ones are cut into blocks
    sizes = around.groupBy("root").agg(F.count("*").alias("members"))
    tasks = max(1, -(-around.count() // block))
    placed = around.join(sizes, "root").withColumn("blocks", F.ceil(F.col("members") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", low, high))
    placed = placed.select(F.col("shown").alias("row"), "node", "root", "copies", "own", low.alias("low"), high.alias("high"), task.alias("task"))
    # the same plan at every size: texts are shuffled once, whatever the planner thinks of the other side
    texts = numbered.select("row", "text").join(placed.hint("merge"), "row")

    def compare(table: pa.Table) -> pa.Table:
        root = np.asarray(table.column("root"))
        node, copies, side = (np.asarray(table.column(c), np.int64) for c in ("node", "copies", "own"))
        low, high = np.asarray(table.column("low")), np.asarray(table.column("high"))
        order = np.lexsort((node, high, low, root))
        cut = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        out: list[tuple[int, int, int]] = []
        for members in np.split(order, cut):
            sets = ngram_sets(table.column("text").take(pa.array(members)), n)
            here, weight, sides = node[members], copies[members], side[members]
            split = low[members[0]] != high[members[0]]
            left = np.flatnonzero(sides == low[members[0]]) if split else np.arange(len(members))
            right = np.flatnonzero(sides == high[members[0]]) if split else None
            linked = np.zeros(len(members), np.int64)
            parent = np.arange(len(members))

            def top(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, others in similar_pairs(sets, left, right, threshold, tolerance):
                linked[i] += weight[others].sum()
                linked[others] += weight[i]
                for j in others:
                    a, b = top(i), top(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            out += [(0, int(a), int(c)) for a, c in zip(here, linked) if c]
            out += [(1, int(here[k]), int(here[top(k)])) for k in range(len(members)) if top(k) != k]
        kind, a, b = zip(*out) if out else ((), (), ())
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = stage_table(texts.groupBy("task").applyInArrow(compare, "kind int, a bigint, b bigint"))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    groups = components(found.filter("kind = 1").select("a", "b"))
    named = groups.join(classes.select("node", "class_id"), "node")
    smallest = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    facts = (
        classes.select("node", "class_id", "copies").join(links, "node", "left")
        .join(groups.join(smallest, "root").select("node", "root", "group_id"), "node", "left")
        .select(F.col("node").alias("__node"), F.coalesce("root", "node").alias("component"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return keys.select("row", "doc_id", "node").join(facts, F.col("node") == F.col("__node"), "left").select(
        "row", "doc_id", "node", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group: the row with the smallest id, or among equal ids the first; all those without words."""
    linked = stage_table(link_documents(docs, doc_id, text, n, threshold))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stay = linked.filter("node is not null").groupBy("component").agg(first).select("first.row").unionByName(linked.filter("node is null").select("row"))
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    return numbered.join(stay.withColumnRenamed("row", "__row").hint("merge"), "__row", "left_semi").select(*docs.columns)
