"""Recursive text splitting and the chunk table."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.constants import CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_SEPARATORS, MIN_CHUNK_CHARS, WS_CHARS
from vellum.functions.text import strip
from vellum.session import spread


#: Error text of a row whose text cannot be told by offsets.
UNMAPPED = "chunk is not a part of the text"

#: Characters of rows that leave a task of the splitter at once.
OUTPUT_CHARS = 4 * 1024 * 1024


def check_limits(max_chars: int, overlap: int) -> None:
    """A chunk holds at least one character and more than it repeats of the one before."""
    if type(max_chars) is not int or type(overlap) is not int or not 0 <= overlap < max_chars:
        raise ValueError(f"a chunk of {max_chars} characters cannot repeat {overlap}")


Span = tuple[int, int]


def _parts(text: str, span: Span, separator: str) -> list[Span]:
    """Non-empty stretches between separators."""
    found, at = [], span[0]
    while at <= span[1]:
        end = text.find(separator, at, span[1])
        end = span[1] if end < 0 else end
        if end > at:
            found.append((at, end))
        at = end + len(separator)
    return found


def _packed(parts: list[Span], glue: int, size: int, overlap: int) -> Iterator[list[Span]]:
    """Runs of parts of at most `size` characters; a run opens with the last parts of the one before, up to `overlap`."""
    run: deque[Span] = deque()
    chars = 0
    for part in parts:
        more = part[1] - part[0]
        if run and chars + more + len(run) * glue > size:
            yield list(run)
            while run and (chars > overlap or chars + more + len(run) * glue > size):
                first = run.popleft()
                chars -= first[1] - first[0]
        run.append(part)
        chars += more
    if run:
        yield list(run)


def _runs(text: str, span: Span, size: int, overlap: int, separators: list[str]) -> Iterator[tuple[list[Span], str, bool]]:
    """(parts, what joins them, whether the ends are trimmed): split at the coarsest separator present, finer for what stays too long."""
    level = next((i for i, s in enumerate(separators) if text.find(s, *span) >= 0), len(separators) - 1)
    glue, finer = separators[level], separators[level + 1 :]
    short: list[Span] = []
    for part in [*_parts(text, span, glue), None]:
        if part and part[1] - part[0] < size:
            short.append(part)
            continue
        for run in _packed(short, len(glue), size, overlap):
            yield run, glue, True
        short = []
        if part and finer:
            yield from _runs(text, part, size, overlap, finer)
        elif part:
            yield [part], glue, False


def split_text(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, separators: list[str] = CHUNK_SEPARATORS) -> list[tuple[str, int, int]]:
    """(chunk, start, end) with the offsets that the split itself found.

    A separator that stands twice leaves an empty part, which is dropped; a
    chunk over such a place is not a part of the text. That raises ValueError,
    as the whole text then has no offsets.
    """
    chunks = []
    for run, glue, trimmed in _runs(text, (0, len(text)), size, overlap, separators):
        start, end = run[0][0], run[-1][1]
        chunk = text[start:end]
        if trimmed:
            start += len(chunk) - len(chunk.lstrip(WS_CHARS))
            chunk = chunk.strip(WS_CHARS)
            if not chunk:
                continue
        if any(b[0] - a[1] != len(glue) for a, b in zip(run, run[1:])):
            raise ValueError(UNMAPPED)
        chunks.append((chunk, start, start + len(chunk)))
    return chunks


def split_to_rows(
    df: DataFrame, text_col: str = "text", max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, separators: list[str] = CHUNK_SEPARATORS,
) -> DataFrame:
    """One row per chunk with its offsets, length and overlap with the one before; the other columns are repeated.

    A text that cannot be told by offsets gives one row with `split_error` and
    no chunk; null and empty texts give none. Each task splits the texts it
    read.
    """
    check_limits(max_chars, overlap)
    carried = [f for f in df.schema.fields if f.name != text_col]
    made = T.StructType().add("chunk_index", "integer").add("text", "string").add("source_start_char", "integer").add("source_end_char", "integer") \
        .add("char_count", "integer").add("context_chars", "integer").add("split_error", "string")
    names = [f.name for f in carried]

    def tables(batch: pd.DataFrame, numbers: list[int], rows: list[tuple]) -> pd.DataFrame:
        out = batch[names].iloc[numbers].reset_index(drop=True)
        columns = pd.DataFrame(rows, columns=made.names).astype({c: "Int32" for c in made.names if c not in ("text", "split_error")})
        return pd.concat([out, columns], axis=1)

    def split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, rows, size = [], [], 0
            # the carried texts of a row are repeated for every chunk, so chunks leave in tables of bounded characters
            wide = sum((batch[c].map(lambda v: len(v) if isinstance(v, (str, bytes, bytearray)) else 8) for c in names), start=pd.Series(64, index=batch.index)).tolist()
            for at, text in enumerate(batch[text_col]):
                if not text:
                    continue
                try:
                    found = split_text(text, max_chars, overlap, separators)
                except ValueError as error:
                    numbers.append(at)
                    rows.append((None, None, None, None, None, None, str(error)))
                    continue
                before = 0
                for i, (chunk, start, end) in enumerate(found, 1):
                    numbers.append(at)
                    rows.append((i, chunk, start, end, len(chunk), max(0, before - start) if i > 1 else 0, None))
                    before = end
                    size += wide[at] + len(chunk)
                    if size >= OUTPUT_CHARS:
                        yield tables(batch, numbers, rows)
                        numbers, rows, size = [], [], 0
            yield tables(batch, numbers, rows)

    return spread(df).mapInPandas(split_batches, T.StructType([*carried, *made.fields]))


def with_context(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Length and overlap with the chunk before, for chunk tables that do not carry them.

    The window spans one text only. split_to_rows() already knows both.
    """
    w = Window.partitionBy(*keys).orderBy("chunk_index")
    return chunks.withColumns(
        {
            "char_count": F.length("text"),
            "context_chars": F.coalesce(
                F.greatest(F.lit(0), F.lag("source_end_char").over(w) - F.col("source_start_char")), F.lit(0)
            ),
        }
    )


def indexable(chunks: DataFrame, min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Chunks long enough to index; ordinals are not renumbered."""
    return chunks.filter(F.length(strip(F.col("text"))) >= min_chars)
