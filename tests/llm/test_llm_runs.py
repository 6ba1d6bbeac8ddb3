"""Periodic runs against plain loops."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from vellum.llm import periodic_runs
from vellum.llm.registry import R

FOLDER = "/root/testdata/sf0.001"


def plain_runs(w):
    """(start, length, period) of all runs: every stretch of every period, the least period of each."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def described(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("points", [500, 1 << 21])
def test_runs_of_random_words(monkeypatch, points):
    monkeypatch.setattr(periodic_runs, "POINTS", points)
    r = random.Random(points)
    for _ in range(80):
        texts = []
        for _ in range(r.randint(1, 6)):
            n, kind = r.choice([0, 1, 5, 23, 24, 30, 80, 200, 400]), r.random()
            w = [r.randrange(3) for _ in range(n)] if kind < 0.3 else [1] * n
            if 0.3 <= kind < 0.7:
                w = []
                while len(w) < n:
                    w += [r.randrange(50) for _ in range(r.randint(1, 20))] * r.randint(1, 9) + [r.randrange(3) for _ in range(r.randint(0, 3))]
            elif 0.7 <= kind < 0.9:
                a, w = [0], [0, 1]
                while len(w) < n:
                    a, w = w, w + a
            texts.append(w)
        got = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), np.cumsum([0] + [len(t) for t in texts]))
        assert got.tolist() == [[k, *x] for k, t in enumerate(texts) for x in plain_runs(t)]


def test_extensions_of_all_pairs():
    r = random.Random(4)
    text = np.array([r.randrange(2) for _ in range(150)] + [0, 1] * 60 + [9])
    found = periodic_runs.Extensions(text)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(text)), np.arange(len(text))))
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i.tolist(), j.tolist(), found.of(i, j).tolist()):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        assert n == k


@pytest.mark.parametrize("plant", [False, True])
def test_descriptions(spark, monkeypatch, plant):
    monkeypatch.setattr(periodic_runs, "BATCH_BYTES", 3000)
    r = random.Random(5)
    rows = [(None, None), (None, "ho " * 30), (1, ""), (2, " \n\t "), (3, "a\x0bb\x1cc d " * 30), (3, "a\x0bb\x1cc d " * 30), (10, "é  x\n" * 5000), (11, "x y " * 12 + "z " * 24), (-7, "one")]
    rows += [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 300)))) for k in range(20, 90)]
    df = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id bigint, text string, length int, runs string")
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = [tuple(x) for x in periodic_runs.describe_runs(df, plant=plant).select(*names).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted((described(i, t, plant) for i, t in rows), key=key)
    assert periodic_runs.describe_runs(df.limit(0)).count() == 0


def test_query_by_brute_force(spark):
    got = sorted(tuple(x) for x in R.queries["op11_periodic_runs"](spark, FOLDER).collect())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(described(r.doc_id, r.text, True) for r in docs) and sum(x[1] > 0 for x in got) > 3
