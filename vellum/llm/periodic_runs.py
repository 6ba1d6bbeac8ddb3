"""Maximal periodic runs of words, found on a harmonic grid with constant-time common extensions.

A difference cover is a set of residues modulo v in which every difference
occurs. Only suffixes that start at covered positions are sorted, with the
common prefixes of neighbours in a sparse table for range minima. Any two
positions reach two covered ones after the same few words, so a longest common
extension compares fewer than v words and reads one minimum.

A run of period q and length max(24, 3 q) or more repeats itself over a stretch
of 2 q or more words, so it holds two neighbouring points of a grid of that half
width; all grids together have n log n points. Points where the words match are
extended both ways; everything works on arrays of a bounded batch of texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vellum.llm.textbytes import flat, words

#: Shortest run, and the least number of periods in it.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Every difference modulo the first number occurs among the residues (a perfect difference set).
COVER_MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of text worked on at once (one longer text is taken alone), and grid points or pairs of an array.
BATCH_BYTES, POINTS = 4 << 20, 1 << 21
_EMPTY = np.zeros(0, np.int64)


class Extensions:
    """Longest common extensions to the right of any two positions of an integer text."""

    def __init__(self, text: np.ndarray, modulus: int = COVER_MODULUS, cover: tuple[int, ...] = COVER) -> None:
        """No two positions may have the same rest: the text ends in a value that occurs once."""
        self.v, n = modulus, len(text)
        self.text = np.zeros(n + 2 * modulus, ">u4")
        self.text[:n] = text + 1
        self.slot = np.full(modulus, -1)
        self.slot[list(cover)] = np.arange(len(cover))
        self.size = len(cover)
        # for every difference a pair of residues: how far the first is reached
        self.reach = np.zeros(modulus, np.int64)
        for x in cover:
            for y in cover:
                self.reach[(y - x) % modulus] = x
        rows = -(-n // modulus)
        self.at = (np.arange(rows)[:, None] * modulus + np.array(cover)).ravel()
        self.at = self.at[self.at < n]
        self._sort()

    def _blocks(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.text, self.v)[at]

    def _sort(self) -> None:
        m = len(self.at)
        blocks = np.ascontiguousarray(self._blocks(self.at))
        keys = blocks.view(f"S{4 * self.v}").ravel()
        order = np.argsort(keys, kind="stable")
        new = np.ones(m, bool)
        new[1:] = (blocks[order[1:]] != blocks[order[:-1]]).any(1) if m > 1 else True
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        # ranks of 1, 2, 4, ... blocks; a suffix that has ended ranks 0
        levels, hop = [rank], 1
        while m and levels[-1].max() < m:
            rank = levels[-1]
            after = np.zeros(m, np.int64)
            jump = hop * self.size
            after[: max(0, m - jump)] = rank[jump:]
            key = rank * (m + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.ones(m, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(new)
            levels.append(rank)
            hop *= 2
        self.place = levels[-1] - 1
        order = np.argsort(self.place, kind="stable")
        shared = self._shared(order[:-1].copy(), order[1:].copy(), levels) if m > 1 else np.zeros(0, np.int64)
        self.minima = [shared]
        width = 1
        while 2 * width <= len(shared):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def _shared(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of the suffixes of pairs of samples, from the ranks of blocks downwards."""
        m, total = len(self.at), np.zeros(len(a), np.int64)
        for k in reversed(range(len(levels))):
            inside = (a < m) & (b < m)
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            total += same * (self.v << k)
            a, b = a + same * (self.size << k), b + same * (self.size << k)
        out = total
        for low in range(0, len(a), max(1, POINTS // self.v)):
            part = slice(low, low + max(1, POINTS // self.v))
            # within this block at the latest both differ
            x, y = self._blocks(self.at[np.minimum(a[part], m - 1)]), self._blocks(self.at[np.minimum(b[part], m - 1)])
            out[part] += np.where((a[part] < m) & (b[part] < m), np.argmax(x != y, axis=1), 0)
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that follow alike at i and j, themselves included; i and j differ pairwise."""
        out = np.empty(len(i), np.int64)
        step = max(1, POINTS // self.v)
        for low in range(0, len(i), step):
            out[low : low + step] = self._of(i[low : low + step], j[low : low + step])
        return out

    def _of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = (self.reach[(j - i) % self.v] - i) % self.v
        differ = self._blocks(i) != self._blocks(j)
        first = np.where(differ.any(1), np.argmax(differ, axis=1), self.v)
        found = np.minimum(first, near)
        far = np.flatnonzero(first >= near)
        if len(far):
            a, b = i[far] + near[far], j[far] + near[far]
            pa_, pb = (self.place[(x // self.v) * self.size + self.slot[x % self.v]] for x in (a, b))
            low, high = np.minimum(pa_, pb), np.maximum(pa_, pb)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level):
                here = level == k
                table = self.minima[k]
                least[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(k))])
            found[far] = near[far] + least
        return found


def _grid(sizes: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, period) of grid points where words, those at the next point and some between repeat after the period."""
    most = sizes // MIN_PERIODS
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (np.maximum(MIN_LENGTH, MIN_PERIODS * period) - period) // 2
    points = (sizes[text] - 1 - period) // step + 1
    keep = (points > 1) & (sizes[text] >= MIN_LENGTH)
    text, period, step, points = text[keep], period[keep], step[keep], points[keep]
    ends = np.cumsum(points)
    low = 0
    while low < len(points):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + POINTS, "right")))
        for part in _points(text[low:high], period[low:high], step[low:high], points[low:high], starts, ids):
            yield part
        low = high


def _points(text, period, step, points, starts, ids) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    own = np.repeat(np.arange(len(points)), points)
    k = np.arange(len(own)) - np.repeat(np.cumsum(points) - points, points)
    at = starts[text][own] + k * step[own]
    same = ids[at] == ids[at + period[own]]
    both = np.flatnonzero(same[:-1] & same[1:] & (own[:-1] == own[1:]))
    for share in (1, 2, 3):
        # all words between the two points repeat too
        between = at[both] + step[own[both]] * share // 4
        both = both[ids[between] == ids[between + period[own[both]]]]
    if len(both):
        yield text[own[both]], at[both], period[own[both]]


def find_runs(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts that lie on end, by text, start and period.

    `ids` are numbers of words, text t is ids[offsets[t]:offsets[t + 1]]. A run
    has its smallest period: periods of one stretch that holds three of them are
    multiples of the smallest, so the stretch is found for each and the least is kept.
    """
    ids, offsets = np.asarray(ids, np.int64), np.asarray(offsets, np.int64)
    found, parts, held = [np.zeros((0, 4), np.int64)], [], 0
    last: list = [None]

    def indexed(used: np.ndarray) -> tuple[np.ndarray, int, Extensions, Extensions]:
        """The texts that hold candidates, each behind a word of its own, forwards and backwards."""
        if last[0] is None or not np.array_equal(last[0], used):
            size = offsets[used + 1] - offsets[used]
            begin = np.cumsum(size + 1) - size
            joined = np.empty(int(begin[-1] + size[-1]) + 1, np.int64)
            top = int(ids.max()) + 1
            joined[begin - 1] = top + np.arange(len(used))
            joined[-1] = top + len(used)
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            joined[np.repeat(begin, size) + inner] = ids[np.repeat(offsets[used], size) + inner]
            last[:] = used, (begin, len(joined) - 1, Extensions(joined), Extensions(joined[::-1]))
        return last[1]

    def extend() -> None:
        text, at, period = (np.concatenate(x) for x in zip(*parts))
        used = np.unique(text)
        begin, back, right, left = indexed(used)
        i = at + begin[np.searchsorted(used, text)] - offsets[text]
        ahead, behind = right.of(i, i + period), left.of(back - i, back - i - period) - 1
        rows = np.stack([text, at - behind - offsets[text], ahead + behind + period, period], axis=1)
        found.append(np.unique(rows[rows[:, 2] >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)], axis=0))

    for part in _grid(np.diff(offsets), offsets[:-1], ids):
        parts.append(part)
        held += len(part[0])
        if held >= POINTS:
            extend()
            parts, held = [], 0
    if parts:
        extend()
    rows = np.unique(np.concatenate(found), axis=0)
    # rows of one stretch lie together, the smallest period first
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[first]


def seeded(doc_ids: list, sizes: np.ndarray) -> np.ndarray:
    """For every word of texts that lie on end the place of the word that stands there: some texts get a periodic end.

    With h = crc32 of the decimal id and g = h // 10, a text with h % 10 = 0
    repeats p words from word a = g % n on. A null id changes nothing.
    """
    starts = np.cumsum(sizes) - sizes
    source = np.arange(int(sizes.sum()))
    for doc_id, n, at in zip(doc_ids, sizes.tolist(), starts.tolist()):
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[at + a : at + n] = at + a + np.arange(n - a) % p
    return source


OUT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start: long, length: long, period: long>>"


def _describe(doc_ids: list, texts: pa.Array, plant: bool) -> dict[str, list]:
    """The columns of OUT for one batch of texts."""
    raw, at = flat(texts)
    start, end, first = words(raw, at)
    size = end - start
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letters = raw[np.repeat(start, size) + inner] if len(inner) else np.zeros(0, np.uint8)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(letters)])
    counts = np.diff(first)
    if plant:
        spelled = spelled.take(pa.array(seeded(doc_ids, counts)))
    ids = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(spelled) else _EMPTY
    rows = find_runs(ids, first)
    # words behind the first period of a run go
    step = np.zeros(len(ids) + 1, np.int64)
    base = first[rows[:, 0]] + rows[:, 1]
    np.add.at(step, base + rows[:, 3], 1)
    np.add.at(step, base + rows[:, 2], -1)
    keep = np.cumsum(step[:-1]) == 0
    kept_before = np.concatenate([[0], np.cumsum(keep)])[first]
    lists = pa.LargeListArray.from_arrays(pa.array(kept_before, pa.int64()), spelled.filter(pa.array(keep)))
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).to_pylist()
    edges = np.searchsorted(rows[:, 0], np.arange(len(counts) + 1))
    out = {name: [] for name in ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", "runs")}
    for k, kept in enumerate(collapsed):
        own = rows[edges[k] : edges[k + 1], 1:].tolist()
        best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
        values = (int(counts[k]), len(own), *best, 1000 * best[1] // best[2] if own else None, hashlib.sha256(listed.encode()).hexdigest(),
                  hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), [{"start": s, "length": n, "period": q} for s, n, q in own])
        for name, value in zip(out, values):
            out[name].append(value)
    return out


def describe_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed, runs) of every row.

    `collapsed` is the text with each run cut to its first period, `runs` lists
    all runs by start and period, and the single columns are those of the run
    with the greatest exponent. `plant` gives a tenth of the texts, chosen by
    id, a periodic end before anything is searched. Rows are independent: no
    shuffle, and a task holds one batch of texts. A null, empty or blank text
    has no words and no runs, and its digests are those of the empty string;
    rows that repeat are answered each; other columns play no part.
    """
    schema = f"{doc_id} {dict(docs.dtypes)[doc_id]}, {OUT}"
    names = [c.split()[0] for c in OUT.split(", ") if c.split()[0] not in ("length:", "period:")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            said, low = batch.column(1), 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(said), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BATCH_BYTES, "right")))
                keys = batch.column(0).slice(low, high - low)
                found = _describe(keys.to_pylist(), said.slice(low, high - low), plant)
                target = target or pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                kinds = {"runs": pa.list_(target)} | {c: pa.string() for c in ("runs_sha256", "collapsed_sha256", "collapsed")}
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(found[c], kinds.get(c, pa.int64())) for c in names]], names=[doc_id, *names])
                low = high

    return docs.select(doc_id, text).mapInArrow(work, schema)
