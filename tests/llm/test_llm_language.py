"""Language ID against plain naive Bayes with dictionaries."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

from vellum.llm import language_id
from vellum.llm.registry import R

FOLDER = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def slots(text):
    """Hash slots of the n-grams of 1 to 3 characters; runs of other than letters are one blank."""
    said = " "
    for c in f" {(text or '').lower()} ":
        letter = unicodedata.category(c)[0] == "L"
        if letter or said[-1] != " ":
            said += c if letter else " "
    for n in language_id.ORDERS:
        for k in range(len(said) - n + 1):
            h = n
            for c in said[k : k + n]:
                h = (h * 0x100000001B3 + ord(c)) & MASK
            h ^= h >> 30
            h = h * 0xBF58476D1CE4E5B9 & MASK
            h ^= h >> 27
            h = h * 0x94D049BB133111EB & MASK
            yield (h ^ h >> 31) >> (64 - language_id.BITS)


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    counts = defaultdict(Counter)
    for r in docs:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            counts[r.lang].update(slots(r.text))
    space = 1 << language_id.BITS
    total = {lang: sum(c.values()) + 0.5 * space for lang, c in counts.items()}
    got = {r.doc_id: r for r in R.queries["op5_language_id"](spark, FOLDER).collect()}
    assert len(got) == len(docs) and len(counts) == 4
    for r in docs:
        score = {lang: sum(n * math.log((counts[lang][s] + 0.5) / total[lang]) for s, n in Counter(slots(r.text)).items()) for lang in counts}
        best = min(score, key=lambda lang: (-score[lang], lang))
        mine = got[r.doc_id]
        assert mine.held_out == held[r.doc_id] and mine.lang_pred == best
        assert abs(mine.score - 1 / sum(math.exp(s - score[best]) for s in score.values())) < 1e-6


def test_rare_languages_and_copies_in_the_sample(spark):
    """Each language has its share; a text that many ids share is thinned out like any other."""
    rows = [(i, f"gewoehnlich und haeufig {i}", "de") for i in range(400)] + [(1000 + i, "the same text again", "en") for i in range(400)] + [(2000 + i, f"rara lingua {i}", "la") for i in range(5)]
    df = spark.createDataFrame([*rows, (None, "no id", "en"), (7, None, "xx"), (8, "none", None)], "doc_id bigint, text string, lang string")
    model = language_id.fit(df, fit_rows=120)
    assert model.languages == ["de", "en", "la"]
    texts = ["gewoehnlich", "the same text", "rara lingua"]
    assert model.score(texts)[0] == ["de", "en", "la"]
    whole = language_id.fit(df.filter("lang = 'la'"), fit_rows=120)
    assert (whole.matrix[0] == model.matrix[2]).all()
    again = language_id.fit(df.repartition(7), fit_rows=120)
    assert (again.matrix == model.matrix).all()
    assert language_id.fit(df.drop("doc_id"), fit_rows=120).languages[0] == "de"
