"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import stage_table

#: Bytes of windows that go into one automaton; more are searched for in several passes. Windows of one piece of an item.
AUTOMATON_BYTES, PIECE = 32 << 20, 1_000
_SPACE = 0x20
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else _SPACE for b in range(256))
_built: dict = {}


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and everything beyond ASCII."""
    return text.translate(_KEEP).split()


def windows(text: str | None, n: int) -> list[str]:
    """The item's windows of n words as the automaton reads them; a shorter item is one window, an empty one none."""
    found = normal_words((text or "").encode())
    if not found:
        return []
    return [(b" " + b" ".join(found[i : i + n]) + b" ").decode("latin-1") for i in range(max(1, len(found) - n + 1))]


def _pieces(n: int, most: int):
    """Items cut into pieces of at most `most` windows, n - 1 words repeated between them, with the bytes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str | None, str, int]] = []
            for item, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = normal_words((said or "").encode())
                starts = max(1, len(found) - n + 1) if found else 0
                for at in range(0, starts, most):
                    count = min(most, starts - at)
                    part = found[at : at + count + n - 1]
                    line = b" ".join(part)
                    rows.append((item, line.decode(), count * (min(n, len(part)) * (len(line) // len(part) + 1) + 1)))
            items, texts, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["item", "said", "size"])

    return run


def _automaton(shared):
    """Built once in each worker from the broadcast pieces; only the windows of one part are held at a time."""
    key = shared.value["key"]
    if key not in _built:
        import ahocorasick

        machine = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for k, said in enumerate(shared.value["said"]):
            for p in windows(said, shared.value["n"]):
                owners.setdefault(p, []).append(k)
        for p, k in owners.items():
            machine.add_word(p, (p.count(" ") - 1, sorted(set(k))))
        if owners:
            machine.make_automaton()
        _built.clear()
        _built[key] = machine if owners else None
    return _built[key]


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, merged [start, end) runs of hit words, items hit) of one text, read once."""
    found = normal_words((text or "").encode())
    if not found or machine is None:
        return len(found), [], set()
    line = " " + b" ".join(found).decode("latin-1") + " "
    hits = list(machine.iter(line))
    if not hits:
        return len(found), [], set()
    # the word that ends before a blank has the number of blanks in front of it, less one
    blanks = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == _SPACE)
    runs: list[tuple[int, int]] = []
    items: set[int] = set()
    for last, (n, owners) in hits:
        end = int(blanks[last]) - 1
        items.update(owners)
        start = end - n
        while runs and runs[-1][1] >= start:
            before = runs.pop()
            start, end = min(start, before[0]), max(end, before[1])
        runs.append((start, end))
    return len(found), runs, items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """[start, end) in characters of the original text for runs of words."""
    raw = text.encode()
    good = np.frombuffer(raw.translate(_KEEP), np.uint8) != _SPACE
    edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    chars = np.cumsum(np.concatenate([[0], (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80]))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               spans: bool = True, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Add n_words, n_hit, item_ids (sorted strings) and leak_spans ([start, end) characters of the original) to every row.

    Items are cut into pieces of at most PIECE windows where they are read, and
    the bytes of all their windows are measured. Up to `automaton_bytes` of
    them go, as pieces, into one broadcast, workers build the automaton from
    it, and the documents are scanned once, without a shuffle. More are dealt
    over parts by a hash of the piece, whatever the lengths of the items; each
    part is scanned for in turn and what it finds is staged, so that the driver
    and the workers hold one part at a time. Runs of words and items of the
    parts are merged row by row, so results do not depend on their number.

    Null and empty texts have no words. Items without words are never found;
    several rows of one item id count as one item; a null item id is left out
    of item_ids but its words count as hit. Columns of `docs` that carry one of
    the added names are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("said"))
    pieces = stage_table(items.mapInArrow(_pieces(n, PIECE), "item string, said string, size bigint").distinct())
    size = pieces.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    added = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("leak_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("__runs", T.ArrayType(T.ArrayType(T.LongType())))])
    added_names = added.names
    out = docs.drop(*added_names)
    own = out.columns
    schema = T.StructType([*out.schema.fields, *added.fields])
    for part in range(parts):
        # bounded by automaton_bytes, up to the unevenness of the hash and one piece
        rows = pieces.filter(F.pmod(F.xxhash64("item", "said"), F.lit(parts)) == part).select("item", "said").collect()
        shared = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "n": n, "items": [r.item for r in rows], "said": [r.said for r in rows]})
        out = out.mapInArrow(_scanner(shared, own, text, spans, part > 0), schema)
        if part + 1 < parts:
            out = stage_table(out)
    return out.drop("__runs")


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _scanner(shared, own: list[str], text: str, spans: bool, more: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, names = _automaton(shared), shared.value["items"]
        for batch in batches:
            texts = batch.column(own.index(text)).to_pylist()
            count, hit, found_items, where, kept = [], [], [], [], []
            before = list(zip(batch.column(len(own) + 2).to_pylist(), batch.column(len(own) + 4).to_pylist())) if more else None
            for k, said in enumerate(texts):
                n, runs, items = scan(said, machine)
                ids = {names[i] for i in items} - {None}
                if before:
                    ids |= set(before[k][0])
                    runs = runs + [tuple(r) for r in before[k][1]]
                runs = _merge(runs)
                count.append(n)
                hit.append(sum(b - a for a, b in runs))
                found_items.append(sorted(ids, key=lambda s: s.encode()))
                where.append([list(s) for s in original_spans(said, runs)] if spans and runs else [])
                kept.append([list(r) for r in runs])
            longs = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(own)], pa.array(count, pa.int64()), pa.array(hit, pa.int64()), pa.array(found_items, pa.list_(pa.string())),
                 pa.array(where, longs), pa.array(kept, longs)],
                names=[*own, "n_words", "n_hit", "item_ids", "leak_spans", "__runs"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Documents without any window of the benchmark, with their own columns."""
    return find_leaks(docs, benchmark, n, spans=False).filter("n_hit = 0").select(*docs.columns)
