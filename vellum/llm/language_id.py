"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.textbytes import mix

#: Log2 of the number of hash slots, lengths of the n-grams, and the expected number of labelled rows the classifier is fitted on.
BITS, ORDERS, FIT_ROWS = 16, (1, 2, 3), 20_000
#: Languages that one model may hold; the matrix has this many columns at most.
MAX_LANGUAGES = 1_000
#: Characters and rows scored at once, which bounds a worker's arrays.
_BATCH_CHARS, _BATCH_ROWS = 1 << 18, 1_000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """True for each code point of a Unicode letter category."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_slots(texts: list[str | None], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, hash slot of every n-gram, text it belongs to) for runs of texts.

    Letters are lower-cased, each run of anything else becomes one blank, and
    a text stands between blanks, so n-grams see word edges. Whole texts count.
    """
    table, start = _letter_table(), 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= _BATCH_CHARS):
            chars += len(texts[stop] or "") + 2
            stop += 1
        codes, owner = [], []
        for k in range(start, stop):
            one = np.frombuffer(f" {(texts[k] or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
            codes.append(one)
            owner.append(len(one))
        code = np.concatenate(codes)
        own = np.repeat(np.arange(start, stop), owner)
        letter = table[code]
        code = np.where(letter, code, 0x20)
        keep = letter.copy()
        keep[1:] |= letter[:-1] | (own[1:] != own[:-1])
        keep[:1] = True
        code, own = code[keep].astype(np.uint64), own[keep]
        slots, owners = [], []
        for n in orders:
            m = len(code) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + code[j : j + m]
            same = own[n - 1 :] == own[:m]
            slots.append((mix(h) >> np.uint64(64 - bits)).astype(np.int64)[same])
            owners.append(own[:m][same])
        yield start, stop, np.concatenate(slots), np.concatenate(owners)
        start = stop


def has_letter(texts: list[str | None]) -> np.ndarray:
    table = _letter_table()
    return np.array([bool(t) and bool(table[np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)].any()) for t in texts], dtype=bool)


class Model:
    """Languages in order of code point and their log probabilities by slot."""

    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray, bits: int, orders: tuple[int, ...]) -> None:
        self.languages, self.prior, self.matrix, self.bits, self.orders = languages, prior, matrix, bits, orders

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, posterior probability) of each text; the first language in order wins a tie."""
        total = np.tile(self.prior, (len(texts), 1))
        for start, stop, slots, owners in gram_slots(texts, self.bits, self.orders):
            for j in range(len(self.languages)):
                total[start:stop, j] += np.bincount(owners - start, self.matrix[j][slots], stop - start)
        seen = has_letter(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        chance = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if s else "und" for b, s in zip(best, seen)], np.where(seen, chance, 0.0)


def _count(bits: int, orders: tuple[int, ...], slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in (b.slice(at, _BATCH_ROWS) for b in batches for at in range(0, b.num_rows, _BATCH_ROWS)):
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                table = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, _, slots, _ in gram_slots(own, bits, orders):
                    table += np.bincount(slots, minlength=1 << bits)
        for lang, table in counts.items():
            for k, part in enumerate(np.split(table, slices)):
                yield pa.RecordBatch.from_pylist([{"lang": lang, "slice": k, "counts": part.tolist()}],
                                                 pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("counts", pa.list_(pa.int64()))]))

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(c.as_py(), np.int64) for c in table.column("counts")], axis=0)
    return pa.table({"lang": table.column("lang")[:1], "slice": table.column("slice")[:1], "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, bits: int = BITS,
        orders: tuple[int, ...] = ORDERS, smoothing: float = 0.5, row_id: str | None = "doc_id") -> Model:
    """Train on rows with a language and a text.

    At most about `fit_rows` rows are used. With more, each language has an
    equal share of them: one with fewer rows gives all of them, of any other a
    row is taken if a hash of its text and id falls below share / rows. So a
    rare language is learned like the others, copies of one text under many ids
    are thinned out like other rows, and reruns agree. Counts per
    language are added up inside the tasks and then per (language, slice of the
    slots); only the finished matrix, languages x 2^bits with at most
    MAX_LANGUAGES languages, reaches the driver. No rows give a model without
    languages, which answers `und`.
    """
    key = [F.col(text), *([F.col(row_id)] if row_id in labelled.columns else [])]
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(*key), F.lit(1 << 30)).alias("draw"))
    known = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if sum(known.values()) > fit_rows:
        share = fit_rows / len(known)
        below = F.create_map(*[F.lit(x) for lang_, n in known.items() for x in (lang_, int(min(1.0, share / n) * (1 << 30)))])
        rows = rows.filter(F.col("draw") < below[F.col("lang")])
    rows = rows.select("lang", "text")
    slices = 8
    schema = "lang string, slice int, counts array<bigint>"
    sums = rows.mapInArrow(_count(bits, orders, slices), schema).groupBy("lang", "slice").applyInArrow(_add, schema)
    got = sums.collect()  # at most MAX_LANGUAGES x slices rows
    languages = sorted({r.lang for r in got}, key=lambda s: s.encode())
    counts = np.zeros((len(languages), slices, (1 << bits) // slices))
    for r in got:
        counts[languages.index(r.lang), r.slice] = r.counts
    counts = counts.reshape(len(languages), 1 << bits) + smoothing
    matrix = np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts
    # a flat prior: the mix of languages of the labelled rows says nothing about a single text
    return Model(languages, np.zeros(len(languages)), matrix, bits, orders)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score (posterior probability) to every row; no shuffle.

    `und` and 0.0 for null, empty or letterless texts. The model is broadcast:
    its size is bounded by MAX_LANGUAGES x 2^bits. Columns that carry an added
    name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "score")
    own = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _BATCH_ROWS) for b in batches for at in range(0, b.num_rows, _BATCH_ROWS)):
            lang, score = shared.value.score(batch.column(own.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*own, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """Documents in a language of the model; those without a letter or torn between languages go."""
    return identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*docs.columns)
