"""Trigram sets, similarities and the suggestion score as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import WORD


def ordered_trigrams(c: Column) -> Column:
    """3-grams of every word, padded by two blanks before and one after."""
    found = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    per_word = F.transform(
        found,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.flatten(per_word)


def trigrams(c: Column) -> Column:
    return F.array_distinct(ordered_trigrams(c))


def _ratio(common: Column, total: Column) -> Column:
    return F.when(total > 0, common.cast("double") / total).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram sets."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def best_extent(query: list[str], ordered: list[str]) -> float:
    """One pass with running counts from every start; runs start and end on a trigram of the query. The plain form that `best_extents` is tested against."""
    asked = set(query)
    best = 0.0
    for start, first in enumerate(ordered):
        if first not in asked:
            continue
        seen: set[str] = set()
        common = 0
        for gram in ordered[start:]:
            if gram not in seen:
                seen.add(gram)
                common += gram in asked
            if gram in asked:
                best = max(best, common / (len(asked) + len(seen) - common))
        if common == len(asked) and best == 1.0:
            break
    return best


#: Window elements that one sweep holds.
_ELEMENTS = 1 << 21


def _numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each item, items on end) of a list column; null lists have none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def best_extents(queries: pa.Array, ordered: pa.Array) -> np.ndarray:
    """`best_extent` of every row of two list columns, as one sweep over arrays.

    A run's score is c / (q + u): distinct trigrams it shares with the query,
    trigrams of the query, and distinct others. Runs begin and end on shared
    trigrams, so the sweep visits those only; others that occur once are counted
    by a prefix sum, and the few that repeat are visited too. An item is new in
    a run if it did not occur between the run's start and itself.
    """
    rows = len(queries)
    q_row, q_items = _numbered(queries)
    o_row, o_items = _numbered(ordered)
    best = np.zeros(rows)
    if not len(q_items) or not len(o_items):
        return best
    coded = pa.concat_arrays([q_items.cast(pa.string()), o_items.cast(pa.string())]).dictionary_encode(null_encoding="encode")
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    asked = np.unique(q_row * size + code[: len(q_items)])
    total = np.bincount(asked // size, minlength=rows)
    key = o_row * size + code[len(q_items) :]
    at = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
    shared = asked[at] == key
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before = np.full(len(key), -1)
    before[order[1:][same]] = order[:-1][same]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    lone = np.cumsum(~shared & ~again)
    visited = np.flatnonzero(shared | again)
    row = o_row[visited]
    end = np.searchsorted(row, row, side="right")
    start = np.flatnonzero(shared[visited])
    span = end[start] - start
    done = np.concatenate([[0], np.cumsum(span)])
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(done, done[low] + _ELEMENTS, "right")) - 1)
        own, length = start[low:high], span[low:high]
        base = np.cumsum(length) - length
        k = np.arange(int(length.sum())) - np.repeat(base - own, length)
        begin = np.repeat(visited[own], length)
        item = visited[k]
        new, common = before[item] < begin, shared[item]
        c, u = np.cumsum(new & common), np.cumsum(new & ~common)
        c = c - np.repeat(np.concatenate([[0], c])[base], length)
        u = u - np.repeat(np.concatenate([[0], u])[base], length) + lone[item] - lone[begin]
        score = np.where(common, c / (total[o_row[begin]] + u), 0.0)
        np.maximum.at(best, row[own], np.maximum.reduceat(score, base))
        low = high
    return best


def with_word_similarity(rows: DataFrame, query: str, ordered: str, out: str = "word_sim") -> DataFrame:
    """Add the best similarity of a query set to any run of an ordered list.

    In Arrow batches, since column expressions need cubic time for it; null or
    empty lists give 0. A table step, as Spark does not pull a UDF out of an
    expression whose arguments hold lambdas.
    """
    own = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = best_extents(batch.column(query), batch.column(ordered))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(out, T.DoubleType())]))


def like_pattern(query: Column, escape: bool = False) -> Column:
    """The query as a LIKE fragment; its own % and _ stay wildcards by default."""
    if escape:
        return F.regexp_replace(query, r"([%_\\])", r"\\$1")
    return F.regexp_replace(query, r"\\(?![%_\\])", "")


def _like(value: Column, pattern: Column) -> Column:
    return F.call_function("like", value, pattern)


def is_prefix(value: Column, query: Column, escape: bool = False) -> Column:
    return _like(value, F.concat(like_pattern(query, escape), F.lit("%")))


def is_word_prefix(value: Column, query: Column, escape: bool = False) -> Column:
    return _like(value, F.concat(F.lit("% "), like_pattern(query, escape), F.lit("%")))


def suggestion_score(value: Column, query: Column, sim: Column, word_sim: Column, escape: bool = False) -> Column:
    """Exact 1000, prefix 700, word prefix 500, contained 100, similarity up to 100."""
    # similarities are single precision; the cast to integer rounds half to even
    best = F.greatest(sim.cast("float"), word_sim.cast("float")).cast("double")
    fuzzy = F.when(F.length(query) >= 3, F.rint(best * 100).cast("int")).otherwise(0)
    return (
        F.when(value == query, 1000).otherwise(0)
        + F.when(is_prefix(value, query, escape), 700).otherwise(0)
        + F.when(is_word_prefix(value, query, escape), 500).otherwise(0)
        + F.when(F.contains(value, query), 100).otherwise(0)
        + fuzzy
    ).cast("int")
