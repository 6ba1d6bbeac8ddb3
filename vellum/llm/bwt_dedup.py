"""Exact byte-level dedup by merging the Burrows-Wheeler transforms of shards.

Texts are parsed into content-defined phrases, and the transform of a shard is
that of its sequence of phrases: one symbol per ~50 bytes instead of one per
byte. The merge is the iterative refinement of the interleave: in each round a
shard sends, for every row of its transform, the symbol in front and the place
its suffix has so far; ranges of symbols put the rows of all shards in order,
so that after k rounds suffixes are ordered by their first k phrases. The order
across shards comes from the rounds alone; a shard makes its own transform anew
in each round from the texts that still hold repeats, which is cheaper than to
keep it in a table. Rows whose interval holds one suffix only are done
and drop out, so later rounds touch repeats alone. What remains after the last
round are intervals with a common prefix of that many phrases; every repeated
string of `length` bytes holds such a prefix at a place its bytes determine.
An exact check of byte strings follows, inside those intervals.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.textbytes import Prefix, flat, mix

#: Bytes of text in a shard, and entries that one range of symbols or strings holds at a time.
SHARD_BYTES, RANGE_ENTRIES = 2 << 20, 1_000_000
#: Phrases of common prefix that the merge refines to, and bytes whose hash places phrase borders.
DEPTH, GRAM = 3, 8
_MESSAGE = "bucket bigint, shard bigint, kind int, data binary"
_ANSWER = "shard bigint, kind int, data binary"
_TOLD, _KEPT = 0, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _smallest(keys: np.ndarray, m: int) -> np.ndarray:
    """Minimum of every m consecutive keys, in blocks that stay in cache."""
    n = len(keys) - m + 1
    out = np.empty(max(0, n), keys.dtype)
    for at in range(0, n, 1 << 16):
        part, width = keys[at : at + (1 << 16) + m - 1], 1
        while 2 * width <= m:
            part = np.minimum(part[:-width], part[width:])
            width *= 2
        if width < m:
            part = np.minimum(part[: len(part) - (m - width)], part[m - width :])
        out[at : at + len(part)] = part[: n - at]
    return out


def _span(length: int, depth: int) -> int:
    """Positions that an anchor is chosen from, so that `depth` phrases behind it still lie inside the string."""
    if length < GRAM + depth + 1 or depth < 1:
        raise ValueError(f"strings of {length} bytes are too short for {depth} phrases")
    return (length - GRAM) // (depth + 1)


class Parse:
    """Phrases of texts. A window of `length` bytes is placed by its anchor: the smallest hash among its first `span` positions.

    Anchors are phrase borders. A window's anchor and the `depth` phrases from
    there on depend on the window's bytes only, so equal windows agree on them.
    """

    def __init__(self, texts, length: int, depth: int) -> None:
        self.data, self.offsets = flat(texts)
        self.length, self.depth, self.span = length, depth, _span(length, depth)
        n, span = len(self.data), self.span
        ends, reach = self.offsets[1:], span + GRAM - 1
        anchor = low = high = np.zeros(0, np.int64)
        if n >= reach:
            grams = np.lib.stride_tricks.as_strided(self.data, (n - GRAM + 1, GRAM), (1, 1)) if n else None
            code = np.ascontiguousarray(grams).view(np.uint64).ravel()
            code = (code * _ODD) ^ (code >> np.uint64(29))
            keys = ((code * _ODD) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(code), dtype=np.uint64))
            del code, grams
            at = (np.uint64(0xFFFFFFFF) - (_smallest(keys, span) & np.uint64(0xFFFFFFFF))).astype(np.int64)
            fits = np.zeros(len(at) + 1, np.int32)
            starts = self.offsets[:-1][ends - self.offsets[:-1] >= reach]
            stops = ends[ends - self.offsets[:-1] >= reach] - reach + 1
            np.add.at(fits, starts, 1)
            np.add.at(fits, stops, -1)
            place = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
            at = at[place]
            if len(at):
                new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                anchor, low, high = at[new], place[new], place[np.append(new[1:], len(at)) - 1]
        self.anchor = anchor
        self.doc = np.searchsorted(self.offsets, anchor, side="right") - 1
        #: windows that start at low .. high have this anchor; none if high < low
        self.low, self.high = low, np.minimum(high, ends[self.doc] - length) if len(anchor) else high
        self.prefix = Prefix(self.data)
        #: whether the phrase from this anchor to the next stays in one text
        self.inner = np.zeros(len(anchor), bool)
        self.inner[:-1] = self.doc[1:] == self.doc[:-1]

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchors that have k phrases behind them, fingerprints of those k phrases)."""
        at = np.flatnonzero(self.doc[: max(0, len(self.doc) - k)] == self.doc[k:]) if len(self.doc) > k else np.zeros(0, np.int64)
        return at, self.label(at, k)

    def label(self, at: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of the k phrases from these anchors on: their bytes and their borders, as the same bytes may be cut in other places (a border depends on bytes behind it too)."""
        a = self.anchor[at]
        out = self.prefix.of(a, self.anchor[at + k])
        for j in range(1, k):
            out = mix(out + (self.anchor[at + j] - a).astype(np.uint64) * _ODD)
        return out


class Bwt:
    """Transform of one shard's phrases: rows in local order of suffixes, the symbol in front of each and that suffix's row."""

    def __init__(self, p: Parse) -> None:
        n = len(p.anchor)
        self.symbol = np.zeros(n, np.uint64)
        at, symbol = p.phrases(1)
        self.symbol[at] = symbol
        rank = np.unique(self.symbol, return_inverse=True)[1] if n else np.zeros(0, np.int64)
        keys = [rank]
        for _ in range(1, p.depth):
            keys.append(np.append(keys[-1][1:], -1)[:n])
        self.suffix = np.lexsort(keys[::-1]) if n else np.zeros(0, np.int64)
        self.row = np.empty(n, np.int64)
        self.row[self.suffix] = np.arange(n)
        before = self.suffix - 1
        self.inner = (before >= 0) & p.inner[before] if n else np.zeros(0, bool)
        self.front = np.where(self.inner, self.symbol[before], np.uint64(0)) if n else self.symbol
        self.lf = np.where(self.inner, self.row[before], -1) if n else before


def _pack(*columns: np.ndarray) -> bytes:
    return np.concatenate([c.astype(np.uint64) for c in columns]).tobytes() if columns else b""


def _unpack(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.uint64).reshape(columns, -1)


def _twice(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows in order, each at most twice: once more says that the shard itself repeats it."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    same = np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        same &= c[1:] == c[:-1]
    again = np.concatenate([[False], same])[: len(order)]
    third = again.copy()
    third[1:] &= again[:-1]
    return [c[~third] for c in columns]


def _dealt(shard: int, key: np.ndarray, buckets: int, columns: list[np.ndarray]) -> list[dict]:
    """Messages to ranges of the key; the order of buckets is that of the keys."""
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    begin = np.concatenate([[0], cut]) if len(bucket) else []
    return [{"bucket": int(bucket[b]), "shard": shard, "kind": _TOLD, "data": _pack(*[c[o] for c in columns])}
            for b, o in zip(begin, np.split(order, cut))]


def _gathered(table: pa.Table, columns: int) -> tuple[list[dict], np.ndarray, list[np.ndarray]]:
    """(rows to hand on, shard of each entry, columns of entries) of one range."""
    kind = table.column("kind").to_pylist()
    handed = [{"shard": s, "kind": _KEPT, "data": d} for s, k, d in zip(table.column("shard").to_pylist(), kind, table.column("data").to_pylist()) if k == _KEPT]
    parts = [(s, _unpack(d, columns)) for s, k, d in zip(table.column("shard").to_pylist(), kind, table.column("data").to_pylist()) if k == _TOLD]
    owner = np.repeat(np.array([s for s, _ in parts], np.int64), [x.shape[1] for _, x in parts])
    return handed, owner, list(np.concatenate([x for _, x in parts], axis=1)) if parts else [np.zeros(0, np.uint64)] * columns


def _answers(handed: list[dict], owner: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """One row per shard with its distinct entries."""
    rows = handed
    order = np.lexsort([*columns[::-1], owner])
    owner, columns = owner[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(owner)) + 1
    for piece in np.split(np.arange(len(owner)), cut) if len(owner) else []:
        distinct = np.unique(np.stack([c[piece] for c in columns]), axis=1)
        rows.append({"shard": int(owner[piece[0]]), "kind": _TOLD, "data": distinct.tobytes()})
    return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())]))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows of sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _interleave(table: pa.Table) -> pa.Table:
    """One range of symbols: rows of all shards in order of (symbol, place so far); intervals of two or more get their new place."""
    bucket = table.column("bucket")[0].as_py()
    handed, owner, (label, symbol, place) = _gathered(table, 3)
    order = np.lexsort((place, symbol))
    begin = _runs(symbol[order], place[order])
    size = np.diff(np.append(begin, len(order)))
    new = np.uint64(bucket << 40) + np.repeat(begin, size).astype(np.uint64) + np.uint64(1)
    kept = np.repeat(size >= 2, size)
    return _answers(handed, owner[order][kept], [label[order][kept], new[kept]])


def _contexts(table: pa.Table) -> pa.Table:
    """Strings around anchors by their common core: 1 repeated as a whole, 2 the same and to show its windows, 3 to be looked at window by window."""
    handed, owner, (core, whole) = _gathered(table, 2)
    order = np.lexsort((owner, whole, core))
    core, whole, owner = core[order], whole[order], owner[order]
    begin = _runs(core, whole)
    size = np.diff(np.append(begin, len(order)))
    group = _runs(core[begin])
    alike = np.repeat(np.diff(np.append(group, len(begin))), np.diff(np.append(group, len(begin))))
    state = np.where(alike == 1, np.where(size >= 2, 1, 0), np.where(size >= 2, 1, 3))
    each = np.repeat(state, size)
    first = np.repeat(owner[begin], size)
    each = np.where((each == 1) & np.repeat(alike > 1, size) & (owner == first), 2, each)
    kept = each > 0
    return _answers(handed, owner[kept], [whole[kept], each[kept].astype(np.uint64)])


def _windows(table: pa.Table) -> pa.Table:
    handed, owner, (window,) = _gathered(table, 1)
    order = np.argsort(window, kind="stable")
    begin = _runs(window[order])
    size = np.diff(np.append(begin, len(order)))
    kept = np.repeat(size >= 2, size)
    return _answers(handed, owner[order][kept], [window[order][kept]])


def _told(answers: pa.Table, columns: int) -> list[np.ndarray]:
    """All entries a shard was told, in order of the first column."""
    parts = [_unpack(d, columns) for k, d in zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist()) if k == _TOLD]
    if not parts:
        return [np.zeros(0, np.uint64)] * columns
    found = np.concatenate(parts, axis=1)
    return list(found[:, np.argsort(found[0], kind="stable")])


def _kept(answers: pa.Table) -> list[bytes]:
    return [d for k, d in zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist()) if k == _KEPT]


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 where it is not among the sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.uint64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.uint64(0))


def cut_repeated_bytes(docs: DataFrame, length: int = 400, text: str = "text", depth: int = DEPTH, shard_bytes: int = SHARD_BYTES,
                       range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_bytes (binary) and removed_spans ([start, end) bytes) to every row, in place of the text.

    Removed is each byte covered by a string of `length` bytes that also starts
    anywhere else, in the same or another row; strings are judged on the input
    and never cross rows. Texts are dealt over shards once, and all rounds read
    that one exchange; from the second round on only texts with repeats are
    parsed. What a shard says about equal strings it says at most twice, so the
    most frequent passage costs a range two entries per shard.

    Strings are compared by 64-bit fingerprints. Null and empty texts have no
    bytes; texts shorter than `length` are kept whole. Columns that carry an
    added name are replaced.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_bytes", "removed_spans"]
    rows = docs.drop(*added)
    own = [c for c in rows.columns if c != text]
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    buckets = max(1, -(-total // (-(-_span(length, depth) // 2) * range_entries)))
    # numbered before the exchange, so that every round knows a row by the same number
    dealt = rows.select(F.col(text), *own, F.monotonically_increasing_id().alias("__row"))
    dealt = dealt.withColumn("__shard", F.pmod(F.xxhash64("__row", F.octet_length(text)), F.lit(shards)))

    def rows_of(table: pa.Table, known: list[bytes] | None) -> tuple[int, np.ndarray, pa.ChunkedArray]:
        """(shard, numbers of rows in order, their texts); all rows, or those handed on."""
        number = np.asarray(table.column("__row"))
        order = np.argsort(number)
        if known is not None:
            order = order[np.isin(number[order], np.frombuffer(b"".join(known), np.int64))]
        return table.column("__shard")[0].as_py(), number[order], table.column(text).take(pa.array(order))

    def message(parts: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(parts, pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())]))

    def hand_on(shard: int, data: bytes) -> dict:
        return {"bucket": shard % buckets, "shard": shard, "kind": _KEPT, "data": data}

    def begin(table: pa.Table) -> pa.Table:
        """Round 1: every phrase, with nothing known of what follows."""
        shard, _, texts = rows_of(table, None)
        symbol = Bwt(Parse(texts, length, depth))
        (front,) = _twice(symbol.front[symbol.inner])
        return message(_dealt(shard, front, buckets, [front, front, np.zeros(len(front), np.uint64)]))

    def refine(k: int) -> Callable:
        """Round k: rows of repeated intervals of k - 1 phrases go to the symbol in front of them."""

        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows or not answers.num_rows:
                return message([])
            shard, number, texts = rows_of(table, _kept(answers) if k > 2 else None)
            p = Parse(texts, length, depth)
            at, label = p.phrases(k - 1)
            place = np.zeros(len(p.anchor), np.uint64)
            place[at] = _lookup(*_told(answers, 2), label)
            b = Bwt(p)
            row = np.flatnonzero(b.inner & (place[b.suffix] > 0))
            row = row[place[b.suffix[b.lf[row]]] > 0]
            target = b.suffix[b.lf[row]]
            key = p.label(target, k)
            alive = np.unique(p.doc[target])
            key, front, before = _twice(key, b.front[row], place[b.suffix[row]])
            return message([*_dealt(shard, front, buckets, [key, front, before]), hand_on(shard, number[alive].tobytes())])

        return run

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Repeated intervals: the string that all windows of an anchor cover, and the part every one of them holds."""
        if not table.num_rows or not answers.num_rows:
            return message([])
        shard, number, texts = rows_of(table, _kept(answers) if depth > 1 else None)
        p = Parse(texts, length, depth)
        core, whole, chosen = _around(p, *_told(answers, 2))
        alive = np.unique(p.doc[chosen])
        core, whole = _twice(core, whole)
        return message([*_dealt(shard, core, buckets, [core, whole]), hand_on(shard, number[alive].tobytes())])

    def _around(p: Parse, keys: np.ndarray, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, label = p.phrases(depth)
        if places is not None:
            at = at[_lookup(keys, places, label) > 0]
        at = at[p.high[at] >= p.low[at]]
        a, low, high = p.anchor[at], p.low[at], p.high[at]
        core = p.prefix.of(a, a + length - p.span)
        whole = mix(p.prefix.of(low, high + length) + (a - low).astype(np.uint64) * _ODD + (a - high).astype(np.uint64))
        return core, whole, at

    def look(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Windows of the strings that are not repeated as a whole; what is decided is handed on as runs of window starts."""
        if not table.num_rows or not answers.num_rows:
            return message([])
        shard, number, texts = rows_of(table, _kept(answers))
        p = Parse(texts, length, depth)
        _, whole, at = _around(p, np.zeros(0, np.uint64), None)
        state = _lookup(*_told(answers, 2), whole)
        show = np.flatnonzero(state == 2)
        show = show[np.unique(whole[show], return_index=True)[1]]
        shown = np.concatenate([show, np.flatnonzero(state == 3)])
        start = _spread(p.low[at[shown]], p.high[at[shown]])
        (window,) = _twice(p.prefix.of(start, start + length))
        facts = []
        for what in (1, 3):
            mine = at[(state == 1) | (state == 2)] if what == 1 else at[state == 3]
            doc = p.doc[mine]
            base = p.offsets[doc]
            facts.append(np.stack([number[doc], np.full(len(mine), what), p.low[mine] - base, p.high[mine] - base]))
        return message([*_dealt(shard, window, buckets, [window]), hand_on(shard, np.concatenate(facts, axis=1).astype(np.int64).T.tobytes())])

    types = {f.name: f for f in rows.schema.fields}
    longs = T.LongType()
    schema = T.StructType([*[types[c] for c in own], *[T.StructField(c, longs) for c in added[:3]], T.StructField("kept_bytes", T.BinaryType()),
                           T.StructField("removed_spans", T.ArrayType(T.ArrayType(longs)))])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        facts = np.concatenate([np.frombuffer(d, np.int64).reshape(-1, 4) for d in _kept(answers)] or [np.zeros((0, 4), np.int64)])
        (repeated,) = _told(answers, 1)
        facts = facts[np.argsort(facts[:, 0], kind="stable")]
        bounds = {int(r): (int(a), int(b)) for r, a, b in zip(*(lambda u, i: (u, i, np.append(i[1:], len(facts))))(*np.unique(facts[:, 0], return_index=True)))}
        sizes, removed, counts, kept, spans = [], [], [], [], []
        for number, said in zip(table.column("__row").to_pylist(), table.column(text).cast(pa.large_binary()).to_pylist()):
            said = said or b""
            sizes.append(len(said))
            edge = np.zeros(0, np.int64)
            if number in bounds:
                mine = facts[slice(*bounds[number])]
                start = _spread(mine[mine[:, 1] == 1][:, 2], mine[mine[:, 1] == 1][:, 3])
                live = mine[mine[:, 1] == 3]
                if len(live):
                    where = _spread(live[:, 2], live[:, 3])
                    prints = Prefix(np.frombuffer(said, np.uint8)).of(where, where + length)
                    start = np.concatenate([start, where[_lookup(repeated, np.ones(len(repeated), np.uint64), prints) > 0]])
                step = np.zeros(len(said) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            cuts = edge.reshape(-1, 2)
            removed.append(int((cuts[:, 1] - cuts[:, 0]).sum()))
            counts.append(len(cuts))
            spans.append(cuts.tolist())
            inside = [0, *edge.tolist(), len(said)]
            kept.append(b"".join(said[inside[i] : inside[i + 1]] for i in range(0, len(inside), 2)))
        return pa.table({c: table.column(c) for c in own} | {
            "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64()),
            "kept_bytes": pa.array(kept, pa.binary()), "removed_spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))})

    def told(messages: DataFrame, answer: Callable) -> DataFrame:
        return messages.groupBy("bucket").applyInArrow(answer, _ANSWER)

    def meet(answers: DataFrame, then: Callable, schema_=_MESSAGE) -> DataFrame:
        return dealt.groupBy("__shard").cogroup(answers.groupBy("shard")).applyInArrow(then, schema_)

    answers = told(dealt.groupBy("__shard").applyInArrow(begin, _MESSAGE), _interleave)
    for k in range(2, depth + 1):
        answers = told(meet(answers, refine(k)), _interleave)
    answers = told(meet(answers, ask), _contexts)
    answers = told(meet(answers, look), _windows)
    return meet(answers, cut, schema)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low .. high."""
    size = high - low + 1
    skipped = np.cumsum(size) - size
    return np.repeat(low - skipped, size) + np.arange(int(size.sum()))
