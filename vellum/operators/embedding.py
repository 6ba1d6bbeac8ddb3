"""Model plug-in for dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import tokenize
from vellum.functions.vectors import hash_embedding
from vellum.session import spread

EMBEDDING_DIM = 1536


def embed(
    df: DataFrame, make_model: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text",
    out_col: str = "dense", dim: int = EMBEDDING_DIM, batch_size: int = 128,
) -> DataFrame:
    """Add a vector column; the model is made once per task and fed batches."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at: at + batch_size]
                vectors = np.asarray(model(part[text_col].tolist()), dtype="float32")
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"expected {len(part)} vectors of {dim}, got {vectors.shape}")
                yield part.assign(**{out_col: list(vectors)})

    return df.mapInPandas(run, schema)


def embed_by_hash(df: DataFrame, text_col: str = "text", out_col: str = "dense", dim: int = 64) -> DataFrame:
    """Offline default: hashed token counts, all inside the JVM."""
    return spread(df).withColumn(out_col, hash_embedding(tokenize(F.col(text_col), compatibility=False), dim))
