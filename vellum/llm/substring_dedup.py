"""Substring dedup with prefix-partitioned suffix trees over words.

Suffixes are split by variable-length prefixes: a prefix that too many
suffixes share is made longer, word by word, until its group fits in memory.
Each group's subtree is built alone. Only nodes as deep as a window (n words)
matter, so subtrees end at that depth, and the edge from a group's prefix to
such a node is kept as one 64-bit fingerprint of its n words instead of the
words. Prefixes are made longer from a broadcast table of bounded size; where
the input is so large that it holds the heaviest only, a group is divided once
more, by the longest prefix there is (the n words). A node with leaves in several places is a repeat; runs of neighbouring
windows make up the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.textbytes import Prefix, combine, covered, flat, mix, starts_inside, words

#: Bytes of text that one task holds at a time, and suffixes of one subtree group.
SHARD_BYTES, GROUP_SUFFIXES = 2 << 20, 1_000_000
#: Bytes of a shard at most; shards grow up to it with the input, so that fewer messages pass between shards and groups.
MAX_SHARD_BYTES, SHARDS = 8 << 20, 16_384
#: Heavy prefixes that may be broadcast, and bounds of id ranges; what is finer than that follows without a table.
MAX_PREFIXES, MAX_CUTS = 1_000_000, 10_000


class Words:
    """The words of many texts and the windows of n words inside them."""

    def __init__(self, texts, n: int) -> None:
        self.data, self.offsets = flat(texts)
        self.start, self.end, self.first = words(self.data, self.offsets)
        self.hash = Prefix(self.data).of(self.start, self.end)
        self.at = starts_inside(self.first, n)
        self.n = n

    def prefix(self, depth: int) -> np.ndarray:
        """Fingerprint of the first `depth` words of every suffix that holds a window."""
        return combine(self.hash, depth)[self.at]


def suffix_groups(w: Words, heavy: list[np.ndarray], groups: int, splits: int = 1) -> np.ndarray:
    """Group of each suffix: by its shortest prefix that is not heavy, at most n words long, and below that by one of `splits` shares of its n words."""
    key = w.prefix(1)
    open_ = np.isin(key, heavy[0]) if len(heavy[0]) else np.zeros(len(key), bool)
    for depth in range(2, w.n + 1):
        if not open_.any():
            break
        longer = w.prefix(depth)
        key = np.where(open_, longer, key)
        open_ &= np.isin(longer, heavy[depth - 1]) if len(heavy[depth - 1]) else False
    place = mix(key)
    if splits > 1:
        place = mix(place + mix(w.prefix(w.n)) % np.uint64(splits))
    return (place % np.uint64(groups)).astype(np.int64)


def leaves(w: Words, heavy: list[np.ndarray], groups: int, splits: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of suffixes by group and label, where a new label begins in it, groups and labels of those)."""
    label, group = w.prefix(w.n), suffix_groups(w, heavy, groups, splits)
    order = np.argsort(label)
    small = group[order].astype(np.uint16 if groups <= 1 << 16 else np.int64)
    order = order[np.argsort(small, kind="stable")]
    label, group = label[order], group[order]
    new = np.ones(len(order), bool)
    new[1:] = (label[1:] != label[:-1]) | (group[1:] != group[:-1])
    begin = np.flatnonzero(new)
    return order, begin, group[begin], label[begin]


def _heavy_counts(n: int, least: int, unit: int):
    """Counts of prefixes that are frequent within a unit of text; longer prefixes only below frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def count() -> pa.RecordBatch:
            w = Words(pa.concat_arrays([h.cast(pa.large_binary()) for h in held]), n)
            depths, keys, counts = [], [], []
            at = w.at
            for depth in range(1, n + 1):
                key = combine(w.hash, depth)[at]
                value, times = np.unique(key, return_counts=True)
                often = value[times >= least]
                if not len(often):
                    break
                depths.append(np.full(len(often), depth))
                keys.append(often.view(np.int64))
                counts.append(times[times >= least])
                at = at[np.isin(key, often)]
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(join(depths), pa.int64()), pa.array(join(keys), pa.int64()), pa.array(join(counts), pa.int64())], names=["depth", "prefix", "times"])

        for batch in batches:
            texts = batch.column(0)
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
            start = 0
            while start < len(texts):  # as many texts as fill the unit
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + unit - size, side="right")))
                held.append(texts.slice(start, stop - start))
                size += int(ends[stop - 1] - (ends[start - 1] if start else 0))
                start = stop
                if size >= unit or start < len(texts):
                    yield count()
                    held, size = [], 0
        if held:
            yield count()

    return run


def heavy_prefixes(docs: DataFrame, text: str, n: int, threshold: int, n_bytes: int, unit: int) -> list[np.ndarray]:
    """Sorted prefixes of each length that at least `threshold` suffixes may share.

    A unit of text reports prefixes it holds at least `least` times, so that
    all it keeps back adds up to less than half of the threshold; every prefix
    at or above the threshold is found. Their number is bounded by 2 n suffixes /
    threshold.
    """
    units = max(1, -(-2 * n_bytes // unit))
    least = max(1, threshold // (2 * units))
    counts = docs.select(text).mapInArrow(_heavy_counts(n, least, unit), "depth bigint, prefix bigint, times bigint")
    got = counts.groupBy("depth", "prefix").agg(F.sum("times").alias("times")).filter(F.col("times") >= threshold // 2).select("depth", "prefix").collect()
    out: list[list[int]] = [[] for _ in range(n)]
    for r in got:
        out[r.depth - 1].append(r.prefix)
    return [np.sort(np.array(x, np.int64).view(np.uint64)) for x in out]


def add_shard(docs: DataFrame, doc_id: str, text: str, shard_bytes: int) -> tuple[DataFrame, int, int]:
    """(rows with `__shard`, shards of rows with an id, bytes): shards are ranges of ids of about equal numbers of rows; rows without id come after them.

    Up to MAX_CUTS ranges have bounds that follow the rows (percentiles); with
    more shards each range is divided evenly by the ids between its bounds.
    """
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0))
    number = F.col(doc_id).cast("long")
    size = docs.agg(F.sum(bytes_).alias("all"), F.sum(F.when(F.col(doc_id).isNull(), bytes_)).alias("none"), F.min(number).alias("low"), F.max(number).alias("high")).first()
    total, none = size["all"] or 0, size["none"] or 0
    shard_bytes = max(shard_bytes, min(MAX_SHARD_BYTES, total // SHARDS))
    wanted = max(1, -(-(total - none) // shard_bytes))
    spare = max(1, -(-none // shard_bytes))
    ranges = min(wanted, MAX_CUTS)
    each = -(-wanted // ranges)
    cuts = np.zeros(0, np.int64)
    if ranges > 1:
        steps = [k / ranges for k in range(1, ranges)]
        cuts = np.unique(np.array(docs.agg(F.percentile_approx(number, steps, max(10_000, 20 * ranges)).alias("c")).first().c or [], np.int64))
    # ids of range k lie above edges[k] and are at most edges[k + 1]
    edges = np.concatenate([[float(size["low"] or 0) - 1], cuts.astype(float), [float(size["high"] or 0)]])
    shards = ranges * each

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy(np.int64)
        inside = np.searchsorted(cuts, values, side="left")
        if each == 1:
            return pd.Series(inside)
        low, high = edges[inside], edges[inside + 1]
        part = (values.astype(float) - low) / np.maximum(high - low, 1.0) * each
        return pd.Series(inside * each + np.clip(np.ceil(part).astype(np.int64) - 1, 0, each - 1))

    lost = F.pmod(F.xxhash64(text), F.lit(spare)) + shards
    return docs.withColumn("__shard", F.when(F.col(doc_id).isNull(), lost).otherwise(place(F.coalesce(F.col(doc_id).cast("long"), F.lit(0))))), shards, total


def cut_repeats(docs: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text", layout: bool = False,
                shard_bytes: int = SHARD_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Add n_words, n_removed, kept_text and removed_spans ([first, last + 1] words) to every row, in place of the text.

    A word goes if a window of n words covers it whose words also start in a
    row with a smaller integer id; windows are judged on the input. kept_text
    joins the kept words by one blank, or, with `layout`, keeps the white
    space after every kept word, so an untouched text stays as it is.

    Texts are dealt over shards (ranges of ids, `shard_bytes` each) once; both
    passes read that one exchange. A shard sends each different window once,
    however often it holds it, as 8 bytes to the group of its prefix, and the
    group answers with one bit per window: whether an earlier shard has it. So
    a passage in a third of all rows costs its group one entry per shard.

    Fingerprints have 64 bits and must meet in one group. Null and empty texts
    have no words; rows without id count as larger than any id and not as
    smaller than each other; rows of one id do not cut each other. Columns that
    carry an added name are replaced.
    """
    added = ["n_words", "n_removed", "kept_text", "removed_spans"]
    rows = docs.drop(*added)
    own = [c for c in rows.columns if c != text]
    sharded, shards, total = add_shard(rows, doc_id, text, shard_bytes)
    suffixes = max(1, total // 3)  # an upper guide: a word and its blank take three bytes or more
    groups = max(1, -(-suffixes // (2 * group_suffixes)))
    wanted = max(1, group_suffixes // 4)
    threshold = max(wanted, -(-2 * n * suffixes // MAX_PREFIXES))  # keeps the table of heavy prefixes below its bound
    splits = -(-threshold // wanted)
    heavy = heavy_prefixes(rows, text, n, threshold, total, shard_bytes) if groups > 1 else [np.zeros(0, np.uint64)] * n
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def send(table: pa.Table) -> pa.Table:
        w = Words(table.column(text), n)
        _, _, group, label = leaves(w, shared.value, groups, splits)
        cut = np.flatnonzero(np.diff(group)) + 1
        parts = np.split(label, cut) if len(label) else []
        return pa.table({
            "group": pa.array(group[np.concatenate([[0], cut])] if len(label) else [], pa.int64()),
            "shard": pa.array([table.column("__shard")[0].as_py()] * len(parts), pa.int64()), "labels": pa.array([p.tobytes() for p in parts], pa.binary())})

    def subtree(table: pa.Table) -> pa.Table:
        """Marks, in the order sent, of the windows that also stand in an earlier shard with ids."""
        shard = np.asarray(table.column("shard"))
        turn = np.argsort(shard, kind="stable")
        parts = [np.frombuffer(table.column("labels")[int(k)].as_py(), np.uint64) for k in turn]
        label = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(label, kind="stable")
        label = label[order]
        new = np.ones(len(label), bool)
        new[1:] = label[1:] != label[:-1]
        lead = np.repeat(owner[order][new], np.diff(np.append(np.flatnonzero(new), len(label))))
        mark = np.zeros(len(label), bool)
        mark[order] = ~new & (shard[turn][lead] < shards)
        out_shard, out_bits = [], []
        for k, piece in enumerate(np.split(mark, np.cumsum([len(p) for p in parts])[:-1])):
            if piece.any():
                out_shard.append(int(shard[turn[k]]))
                out_bits.append(np.packbits(piece).tobytes())
        return pa.table({"shard": pa.array(out_shard, pa.int64()), "group": pa.array([table.column("group")[0].as_py()] * len(out_shard), pa.int64()), "marks": pa.array(out_bits, pa.binary())})

    types = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*[types[c] for c in own], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = Words(table.column(text), n)
        order, begin, group, _ = leaves(w, shared.value, groups, splits)
        earlier = np.zeros(len(begin), bool)
        for g, bits in zip(answers.column("group").to_pylist(), answers.column("marks").to_pylist()):
            lo, hi = np.searchsorted(group, [g, g + 1])
            earlier[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        flags = np.zeros(len(w.hash), bool)
        if len(order):
            ids = np.asarray(pc.fill_null(table.column(doc_id).cast(pa.int64()), 0))
            doc = np.searchsorted(w.first, w.at[order], side="right") - 1
            smallest = np.repeat(np.minimum.reduceat(ids[doc], begin), np.diff(np.append(begin, len(order))))
            flags[w.at[order]] = (ids[doc] > smallest) | np.repeat(earlier, np.diff(np.append(begin, len(order))))
        gone = covered(flags, n)
        counts = np.concatenate([[0], np.cumsum(gone)])
        removed = counts[w.first[1:]] - counts[w.first[:-1]]
        raw = w.data.tobytes()
        kept, spans = [], []
        for k in range(table.num_rows):
            a, b = int(w.first[k]), int(w.first[k + 1])
            said = raw[w.offsets[k] : w.offsets[k + 1]]
            if not removed[k]:
                kept.append(said if layout else b" ".join(said.split()))
                spans.append([])
                continue
            mask = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            spans.append([[int(s), int(e)] for s, e in zip(edge[::2], edge[1::2])])
            if layout:
                begins, base = np.append(w.start[a:b], w.offsets[k + 1]), w.offsets[k]
                at, keep = 0, []
                for s, e in spans[-1]:
                    keep.append(said[at : begins[s] - base])
                    at = int(begins[e] - base)
                kept.append(b"".join([*keep, said[at:]]))
            else:
                kept.append(b" ".join(compress(said.split(), ~mask)))
        columns = {c: table.column(c) for c in own}
        nulls = np.asarray(table.column(text).is_null())
        texts = [None if gone_ else t.decode() for t, gone_ in zip(kept, nulls)] if layout else [t.decode() for t in kept]
        return pa.table(columns | {
            "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string()),
            "removed_spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))})

    sent = sharded.select(F.col(text), "__shard", *own).groupBy("__shard").applyInArrow(send, "group bigint, shard bigint, labels binary")
    answers = sent.groupBy("group").applyInArrow(subtree, "shard bigint, group bigint, marks binary")
    both = sharded.select(F.col(text), "__shard", *own).groupBy("__shard").cogroup(answers.groupBy("shard"))
    return both.applyInArrow(cut, schema)


def drop_repeats(docs: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without their repeated passages, white space kept; those of which no word is left go, those without words stay."""
    cut = cut_repeats(docs, n, doc_id, text, layout=True)
    left = cut.filter("n_removed < n_words or n_words = 0")
    return left.withColumn(text, F.col("kept_text")).select(*docs.columns)
