"""Registered queries of the subpackage against their SQL twins, and the pipeline stage by stage against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F
from test_llm_other import fill
from test_llm_texts import cut_words, links

import corpus_pipeline
from vellum.llm.registry import R

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(R.queries))
def test_matches_sql(spark, con, name):
    rows, problem, _ = compare(spark, con, FOLDER, R.queries[name], R.sql.get(name))
    assert problem is None and rows > 0


def test_stages_by_brute_force(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near copies", "passages", "decontamination", "mixing"]
    odd = [(900_001, "12 34", "en", "a"), (900_002, None, "en", None), (900_003, "", None, "b"), (900_004, "the 5", None, None)]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(*o, None) for o in odd], docs.schema.simpleString().replace("struct<", "").replace(">", "").replace("doc_id:", "doc_id ").replace(":", " ")))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage_table(stage(spark, docs, FOLDER))
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r for r in docs.collect()})
    language, near, passages, clean, mixed = seen
    assert len(language) == 201 and 900_004 in language

    rows = [(i, r.text) for i, r in language.items()]
    _, group, _ = links(rows)
    first = defaultdict(list)
    for (i, _), g in zip(rows, group):
        first[g].append(i)
    assert set(near) == {min(g) for g in first.values()}

    cut = cut_words([(i, r.text) for i, r in near.items()], 13)
    assert {i: r.text.split() for i, r in passages.items()} == {i: k for i, n, k in cut if k or not n}
    assert all(r.text == near[i].text for i, r in passages.items() if len(near[i].text.split()) == len(r.text.split()))
    assert all(r.n_chars == len(r.text) for r in passages.values())

    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() for w in [split(r.text)] for k in range(max(1, len(w) - 9))}
    assert all(len(w) == 10 for w in windows)
    held = lambda t: any(tuple(w[k : k + 10]) in windows for w in [split(t)] for k in range(len(w) - 9))
    assert set(clean) == {i for i, r in passages.items() if not held(r.text)} and len(clean) < len(passages)

    sizes, taken = Counter(), Counter()
    for r in clean.values():
        sizes[r.source] += len(r.text.split())
    for r in mixed.values():
        taken[r.source] += r.taken
        assert 0 < r.taken <= 3 * r.size and r.text == clean[r.doc_id].text
    want = fill(dict(sizes), 3)
    assert all(abs(taken[s] - want[s]) <= 5 for s in want)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.filter(F.col("taken") <= 0).count() == 0 and out.count() > 0
