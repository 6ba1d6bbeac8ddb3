"""Substring dedup, byte dedup, decontamination and the n-gram join against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bwt_dedup, decontamination, ngram_join, substring_dedup

DDL = "doc_id bigint, text string, lang string, n_words int, kept_text string, n_bytes int, row int, n_hit string"


def table(spark, rows):
    """Rows of (doc_id, text), with columns whose names operators add themselves."""
    return spark.createDataFrame([(i, t, "en", 7, "x", 1, 5, "y") for i, t in rows], DDL)


def passages(seed=3, words=40, docs=60):
    """Random texts over few words, with shared passages, copies, near copies, repeated rows, nulls and a long one."""
    r = random.Random(seed)
    some = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(words)]
    said = lambda n: " ".join(r.choice(some) for _ in range(n))
    shared = [said(30) for _ in range(3)]
    rows = []
    for i in range(docs):
        t = said(r.randint(0, 40))
        if i % 3 == 0:
            t = f"{t}\n{shared[i % 9 // 3]}\t {said(5)}"
        rows.append((i * 7 % 101, t))
    copy = rows[5][1] or "copy"
    near = said(200).split()
    rows += [(200 + k, copy) for k in range(12)] + [(300 + k, " ".join([*near[:20 + k], "new", *near[21 + k:]])) for k in range(9)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, said(3000)), (None, shared[0]), (None, shared[0] + " " + copy), rows[3], rows[3], (404, "aaaa " * 50), (405, "one two")]
    return rows


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def cut_words(rows, n):
    """(words, kept words) of each row by definition."""
    first = {}
    place = lambda i: (i is None, i or 0)
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, (True, 1)), place(i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (place(i) if i is not None else (True, 0)):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), [x for x, g in zip(w, gone) if not g]))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900, "group_suffixes": 30}, {"shard_bytes": 1 << 30, "group_suffixes": 4}])
@pytest.mark.parametrize("n", [3, 13])
def test_substring_cut(spark, n, options):
    rows = passages()
    got = substring_dedup.cut_repeats(table(spark, rows), n, **options).collect()
    want = Counter((i, m, " ".join(k)) for i, m, k in cut_words(rows, n))
    assert Counter((r.doc_id, r.n_words, r.kept_text) for r in got) == want
    for r in got:
        assert r.n_removed == r.n_words - len(words_of(r.kept_text)) == sum(b - a for a, b in r.removed_spans)


def test_substring_layout_and_empty_table(spark):
    rows = passages()
    df = table(spark, rows)
    kept = substring_dedup.drop_repeats(df, 13)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, " ".join(words_of(r.text)), r.text is None) for r in kept.collect())
    want = Counter((i, " ".join(k), t is None) for (i, m, k), (_, t) in zip(cut_words(rows, 13), rows) if k or not m)
    assert got == want
    untouched = {(i, t) for (i, m, k), (_, t) in zip(cut_words(rows, 13), rows) if len(k) == m}
    assert untouched <= {(r.doc_id, r.text) for r in kept.collect()}
    assert substring_dedup.cut_repeats(df.limit(0)).count() == 0


def test_variable_prefixes_keep_groups_small(spark):
    """A word in a third of all places is split by longer prefixes."""
    rows = [(i, " ".join(f"the u{i * 50 + k} v{k}" for k in range(50))) for i in range(20)]
    df = table(spark, rows)
    heavy = substring_dedup.heavy_prefixes(df, "text", 5, 100, 20 * 600, 2000)
    assert len(heavy[0]) >= 1 and not len(heavy[1])
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.cut_repeats(df, 5, group_suffixes=400).collect()} == {(i, 0) for i, _ in rows}


def test_substring_cut_beyond_the_tables(spark, monkeypatch):
    """More shards than bounds and more heavy prefixes than the table holds: same rows."""
    monkeypatch.setattr(substring_dedup, "MAX_CUTS", 2)
    monkeypatch.setattr(substring_dedup, "MAX_PREFIXES", 40)
    rows = passages()
    got = substring_dedup.cut_repeats(table(spark, rows), 13, shard_bytes=700, group_suffixes=30).collect()
    assert Counter((r.doc_id, r.n_words, r.kept_text) for r in got) == Counter((i, m, " ".join(k)) for i, m, k in cut_words(rows, 13))
    sharded, shards, _ = substring_dedup.add_shard(table(spark, rows), "doc_id", "text", 700)
    place = {r.doc_id: r["__shard"] for r in sharded.filter("doc_id is not null").collect()}
    assert shards > 20 and len(set(place.values())) > 10 and max(place.values()) < shards
    assert [place[i] for i in sorted(place)] == sorted(place.values())


def test_groups_are_bounded_without_a_table():
    """A prefix of all suffixes that no table holds is divided by the whole window."""
    import pyarrow as pa

    w = substring_dedup.Words(pa.array([" ".join(f"the u{i * 50 + k}" for k in range(50)) for i in range(200)]), 5)
    none = [np.zeros(0, np.uint64)] * 5
    whole = np.bincount(substring_dedup.suffix_groups(w, none, 64, 1), minlength=64)
    split = np.bincount(substring_dedup.suffix_groups(w, none, 64, 64), minlength=64)
    assert whole.max() > len(w.at) / 3 and split.max() < 4 * len(w.at) / 64


def cut_bytes(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + size] for b in raw for k in range(len(b) - size + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("size,depth,options", [(60, 3, {}), (60, 3, {"shard_bytes": 700, "range_entries": 20}), (60, 1, {"shard_bytes": 3000}), (120, 5, {"shard_bytes": 1000, "range_entries": 50})])
def test_bytes_cut(spark, size, depth, options):
    rows = passages(words=25)
    got = bwt_dedup.cut_repeated_bytes(table(spark, rows), size, depth=depth, **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got) == cut_bytes(rows, size)
    assert all(r.n_removed == sum(b - a for a, b in r.removed_spans) for r in got)


def test_bytes_of_empty_tables_and_low_entropy(spark):
    assert bwt_dedup.cut_repeated_bytes(table(spark, [(1, "a")]).limit(0)).count() == 0
    rows = [(1, "a" * 1500), (2, "ab" * 300), (3, "x" * 400), (4, "x" * 399 + "y"), (5, "é" * 300)]
    got = bwt_dedup.cut_repeated_bytes(table(spark, rows), shard_bytes=1000).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got) == cut_bytes(rows, 400)
    with pytest.raises(ValueError):
        bwt_dedup.cut_repeated_bytes(table(spark, rows), 20, depth=30)


def test_bytes_cut_where_phrases_of_equal_bytes_differ(spark):
    """Runs of one word: the same bytes are cut into other phrases by what follows them, and each of the two strings is in one other row only."""
    run = lambda *of: "".join(f"{w} " * n for w, n in of)
    pairs = [(" " + run(("La", 8), ("Stea", 2), ("La", 8)) + "L", " " + run(("La", 8), ("Stea", 1), ("La", 8), ("x", 3))),
             (" " + run(("La", 8), ("x", 3), ("La", 8), ("Stea", 1)), run(("La", 8), ("x", 4), ("Stea", 5)) + "Ste"),
             (" " + run(("La", 4), ("Thon", 3), ("La", 10)) + "La", " " + run(("La", 4), ("Thon", 4), ("x", 4), ("La", 6)) + "L")]
    r = random.Random(5)
    rows = []
    for n, (a, b) in enumerate(pairs):
        assert len(a) == len(b) == 60
        rows += [(10 * n, a + "".join(r.choice("abcdefghijklmnop") for _ in range(200)) + b), (10 * n + 1, a), (10 * n + 2, b)]
    for shard_bytes in (100, 1 << 21):
        got = bwt_dedup.cut_repeated_bytes(table(spark, rows), 60, shard_bytes=shard_bytes).collect()
        assert {(r.doc_id, r.n_removed) for r in got} == {(10 * n + k, 60 if k else 120) for n in range(len(pairs)) for k in range(3)}
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got) == cut_bytes(rows, 60)


def test_planted_passages_by_their_bytes(spark):
    """A passage of over 50 words that two rows hold goes if it has 400 bytes, and stays if it has fewer."""
    r = random.Random(8)
    said = lambda n, k: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k)) for _ in range(n))
    rows, gone = [], {}
    for n, (count, letters) in enumerate([(51, 4), (51, 6), (57, 6), (58, 6), (51, 7), (51, 9), (120, 5)]):
        passage = said(count, letters)
        for k in range(2):
            rows.append((2 * n + k, f"{said(70, 5)}\n{passage}\n{said(70, 5)}"))
            gone[2 * n + k] = len(passage) + 2 if len(passage) + 2 >= 400 else 0
    rows += [(100 + n, said(200, 5)) for n in range(20)]
    got = {x.doc_id: x for x in bwt_dedup.cut_repeated_bytes(table(spark, rows), shard_bytes=2000).collect()}
    assert sorted(v > 0 for v in gone.values()) == [False] * 4 + [True] * 10
    assert all(abs(got[i].n_removed - m) <= 2 and (got[i].n_removed > 0) == (m > 0) for i, m in gone.items())
    assert all(got[100 + n].n_removed == 0 for n in range(20))
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept_bytes)) for x in got.values()) == cut_bytes(rows, 400)


ITEMS = [("a", "Alpha beta, gamma! delta 5 é-ü eps zeta eta theta iota kappa"), ("b", "only four words here"), ("c", ""), (None, "nothing to name it by"), ("d", None), ("b", "four words here again"),
         ("e", "alpha beta gamma delta 5 é ü eps zeta eta")]


def leaks(rows, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, said in items:
            x = split(said)
            for k in range(max(1, len(x) - n + 1) if x else 0):
                win = x[k : k + n]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found - {None}))))
    return Counter(out)


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_leaks(spark, limit):
    rows = [(1, "xx ALPHA beta (gamma) delta 5 É ü"), (2, "say: alpha-beta gamma delta 5 é ü eps zeta eta theta iota kappa lambda"), (3, "Only four words HERE again!"), (4, None), (5, ""), (6, "..."),
            (7, "nothing to name it by nothing to name it by"), (8, "word " * 5000 + "only four words here"), (2, "clean"), (None, "only four words here"), (9, "lonely four words here")]
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = decontamination.find_leaks(table(spark, rows), bench, automaton_bytes=limit).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found) == leaks(rows, ITEMS)
    said = {(r.doc_id, r.text): r.leak_spans for r in found}
    a, b = said[3, rows[2][1]][0]
    assert rows[2][1][a:b] == "Only four words HERE again"
    assert decontamination.find_leaks(table(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.find_leaks(table(spark, rows).limit(0), bench).count() == 0
    clean = decontamination.drop_contaminated(table(spark, rows), bench)
    assert clean.columns == table(spark, rows).columns and {r.doc_id for r in clean.collect()} == {i for i, _, h, _ in leaks(rows, ITEMS) if not h}


def test_leaks_of_long_items_over_parts(spark, monkeypatch):
    """One item is cut into pieces that are searched for in several passes; the same rows as in one."""
    monkeypatch.setattr(decontamination, "PIECE", 7)
    said = [f"k{i % 90}" for i in range(200)]
    items = [("long", " ".join(said)), ("short", "k1 k2 k3"), ("long", "k5 k6 k7 k8 k9 k10 k11 k12 k13 k14 k15")]
    rows = [(1, " ".join(said[15:45])), (2, " ".join(said[30:39])), (3, "x k1 k2 k3 y " + " ".join(said[100:112])), (4, " ".join(said)), (5, None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for limit in (1 << 20, 2_000):
        found = decontamination.find_leaks(table(spark, rows), bench, automaton_bytes=limit).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found) == leaks(rows, items)


def links(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else None)
    linked = [[j for j, y in enumerate(sets) if j != i and x and y and len(x & y) / len(x | y) >= threshold] for i, x in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(rows))]
    ids = lambda members: min((rows[m][0] for m in members if rows[m][0] is not None), default=None)
    out = []
    for i, (d, _) in enumerate(rows):
        same = [j for j in range(len(rows)) if sets[j] is not None and sets[j] == sets[i]] or [i]
        out.append((d, ids(same), ids([j for j in range(len(rows)) if group[j] == group[i]]), len(linked[i])))
    return Counter(out), group, sets


@pytest.mark.parametrize("block", [512, 4])
def test_links(spark, block):
    rows = passages(words=400)
    want, group, sets = links(rows)
    got = ngram_join.link_documents(table(spark, rows), block=block).collect()
    assert Counter((r.doc_id, r.class_id, r.group_id, r.n_links) for r in got) == want
    kept = ngram_join.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert kept.count() == len({g for g, s in zip(group, sets) if s is not None}) + sum(s is None for s in sets)
    assert ngram_join.link_documents(table(spark, rows).limit(0)).count() == 0


def test_bands_follow_the_threshold(spark):
    assert ngram_join.band_shape(0.8) == (40, 5)
    for t in (0.05, 0.3, 0.5, 0.7, 0.9, 1.0):
        bands, rows = ngram_join.band_shape(t)
        assert (1 - t**rows) ** bands <= ngram_join.MISS and (bands <= ngram_join.BANDS or rows == 1)
    with pytest.raises(ValueError):
        ngram_join.band_shape(0.0)
    rows = passages(words=400, docs=30)
    base = [f"b{k}" for k in range(60)]
    rows += [(500 + k, " ".join(base[: 60 - 3 * k] + [f"n{k}x{j}" for j in range(3 * k)])) for k in range(8)]
    want, _, _ = links(rows, threshold=0.5)
    got = ngram_join.link_documents(table(spark, rows), threshold=0.5).collect()
    assert Counter((r.doc_id, r.class_id, r.group_id, r.n_links) for r in got) == want


def test_least_matches_bound_the_posterior():
    from math import comb

    least = ngram_join.least_matches(0.8, 1e-7)
    for n, m in zip(range(16, 129, 16), least):
        tail = lambda k: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1))  # noqa: B023, E731
        assert tail(m) >= 1e-7 and (m == 0 or tail(m - 1) < 1e-7)
    assert least == sorted(least) and least[-1] > 64


def test_queries_by_brute_force(spark):
    from vellum.llm.registry import R

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = R.queries["op4_repeated_bytes"](spark, folder).collect()
    want = {(i, n, m, s, hashlib.sha256(k).hexdigest()) for i, n, m, s, k in cut_bytes(rows, 400)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
