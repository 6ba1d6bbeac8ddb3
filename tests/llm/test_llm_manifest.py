"""Merkle manifest against plain trees."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from vellum.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def trees(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = [sha(*map(said, r)) for r in rows]
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[r[1]].append(k)
    steps = [[] for _ in rows]

    def join(nodes):
        while len(nodes) > 1:
            above = []
            for a in range(0, len(nodes), 3):
                run = nodes[a : a + 3]
                for j, (_, members) in enumerate(run):
                    around = "".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])
                    for k in members:
                        steps[k].append(around)
                above.append((sha(*[d for d, _ in run]), [k for _, members in run for k in members]))
            nodes = above
        return nodes[0]

    tops = {}
    for s, members in groups.items():
        members.sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        tops[s] = join([(leaf[k], [k]) for k in members])
    root = join([tops[s] for s in sorted(tops, key=lambda s: (s is not None, (s or "").encode()))])[0] if tops else None
    out = []
    for k, r in enumerate(rows):
        d = leaf[k]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
            d = sha(*map(said, (*r[:4], r[4].replace("\n", ""))))
        for before, after in steps[k]:
            d = sha(before, d, after)
        out.append((r[0], leaf[k], tops[r[1]][0], root, sha(*[b + a for b, a in steps[k]]), d, d == root))
    return out


def check(spark, rows):
    names = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    df = spark.createDataFrame([(*r, "other", 7) for r in rows], f"{names}, leaf string, i int")
    got = [tuple(r)[:7] for r in merkle.manifest(df).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(trees(rows), key=key)
    return got


def test_odd_rows(spark):
    rows = [(5, None, "en", 3, "a\nb"), (5, None, "en", 3, "a\nb"), (None, "", None, None, None), (None, "é", "x", 0, ""), (-1, "z", "en", 1, "\n" * 9), (7, "z", None, 2, None),
            (8, "Z", "en", 2, "no line"), (2, "z", "long", 400_000, "wörd \n" * 80_000), (2, "z", "other", 1, "same id")]
    got = check(spark, rows)
    assert len(got) == len(rows) and {r[-1] for r in got} == {True, False}
    assert check(spark, []) == []
    # a lone row is its own root and has no siblings
    assert check(spark, rows[:1])[0][4] == sha()


@pytest.mark.parametrize("levels", [1, 2])
def test_small_buckets_climb_in_rounds(spark, monkeypatch, levels):
    """Sources and the tree over the sources go through several rounds of buckets; no row count is special."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "WIDTH", 3**levels)
    r = random.Random(levels)
    sizes = [30, 1, 2, 3, 4, 9, 10, 27, 28]
    rows = [(r.randrange(10**6), f"s{k}", "en", 1, f"line\n{r.random()}") for k, n in enumerate(sizes) for _ in range(n)]
    check(spark, rows)
