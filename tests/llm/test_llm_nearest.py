"""Adaptive dimension scan against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from vellum.llm import adaptive_scan
from vellum.llm.registry import R

FOLDER = "/root/testdata/sf0.1"


def nearest(rows, asked, k):
    """{query_id: [(distance, id), ...]} over usable vectors; an id counts once with its least distance."""
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    lengths = [len(v) for _, v in good]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    best = defaultdict(dict)
    for q, v in good:
        if q in asked and len(v) == dims:
            for i, w in good:
                if i != q and len(w) == dims:
                    d = math.sqrt(sum((np.float64(np.float32(a)) - np.float64(np.float32(b))) ** 2 for a, b in zip(v, w)))
                    best[q][i] = min(d, best[q].get(i, d))
    return {q: sorted((d, i) for i, d in found.items())[:k] for q, found in best.items()}


def as_lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect()):
        out[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return dict(out)


DDL = "vec_id bigint, embedding array<float>, label int, rank int, list int, score string"


def test_odd_vectors(spark):
    """Everything is within one list here, so the answer has to be exact."""
    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 2.0], [1.0, 2.0], [1.0, 2.0], None, [0.0, -0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0], [3.0, 0.0], [3.0, -0.0], [-1.0, 0.5], [1.0, 2.5], []]
    rows = list(enumerate(vectors)) + [(None, [1.0, 1.0]), (9, [3.0, 0.0]), (20, [0.5, 0.5]), (20, [4.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, "s") for r in rows], DDL)
    for k in (1, 3, 50):
        got = as_lists(adaptive_scan.search(df, df, k))
        want = nearest(rows, {i for i, _ in rows}, k)
        assert got.keys() == want.keys()
        for q in want:
            assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], atol=1e-12)
    assert adaptive_scan.search(df.limit(0), df, 3).count() == 0
    assert adaptive_scan.search(df, df.limit(0), 3).count() == 0
    lone = df.filter("vec_id = 11")
    assert adaptive_scan.search(lone, lone, 3).count() == 0


def test_one_hot_vector_and_small_cells(spark, monkeypatch):
    """A vector that a third of the rows share, in cells far smaller than its list; equal distances end on ids."""
    monkeypatch.setattr(adaptive_scan, "CELL_ROWS", 7)
    monkeypatch.setattr(adaptive_scan, "CELL_QUERIES", 3)
    monkeypatch.setattr(adaptive_scan, "STEP_ROWS", 4)
    r = random.Random(8)
    rows = [(i, [1.0] * 20 if i % 3 == 0 else [r.gauss(0, 1) for _ in range(20)]) for i in range(240)]
    df = spark.createDataFrame([(*x, 1, 2, 3, "s") for x in rows], DDL)
    asked = {i for i, _ in rows if i % 5 == 0}
    got = as_lists(adaptive_scan.search(df, df.filter("vec_id % 5 = 0"), 4))
    want = nearest(rows, asked, 4)
    assert got.keys() == want.keys() and all(len(v) == 4 for v in got.values())
    assert all([i for _, i in got[q]] == [i for i in range(0, 240, 3) if i != q][:4] for q in asked if q % 3 == 0)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_tests_abandon_most_and_lose_few():
    """One list scanned: the true neighbours survive, and most rows end before the last block."""
    r = np.random.default_rng(3)
    rows = r.standard_normal((4000, 64)) * np.linspace(2, 0.2, 64)
    queries = rows[:20] + 0.1 * r.standard_normal((20, 64))
    turn = adaptive_scan.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    columns = [(rows @ turn)[:, a:b].astype(np.float32).astype(np.float64) for a, b in adaptive_scan._blocks(64)]
    far = np.sqrt(((queries[:, None] - rows[None]) ** 2).sum(2))
    bound = np.sort(far, axis=1)[:, 9].copy()
    pieces = list(adaptive_scan.scan(columns, rows, queries @ turn, queries, bound, 10))
    found = {(q, i) for a, b, _ in pieces for q, i in zip(a.tolist(), b.tolist())}
    true = {(q, i) for q in range(20) for i in np.argsort(far[q])[:10].tolist()}
    assert len(found & true) >= 0.99 * len(true) and len(found) < 0.05 * far.size


def test_recall_of_the_query(spark):
    got = as_lists(R.queries["op12_adaptive_scan"](spark, FOLDER))
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    values, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    hits = 0
    for at in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((values - values[at]) ** 2).sum(1))
        far[at] = np.inf
        mine = got[ids[at]]
        hits += len({i for _, i in mine} & set(ids[np.lexsort((ids, far))[:10]].tolist()))
        place = {i: d for i, d in zip(ids.tolist(), far.tolist())}
        assert len(mine) == 10 and mine == sorted(mine) and all(abs(place[i] - d) < 1e-12 for d, i in mine)
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("rows", [1, 2, 7])
def test_fit_on_few_rows(rows):
    sample = np.random.default_rng(rows).standard_normal((rows, 5))
    lists = adaptive_scan.fit_lists(sample, 3, 10)
    assert 1 <= lists.probes <= len(lists.centroids) <= 3
