"""A deterministic embedder behind the interface that a model would have: hashed words and word
pairs, pooled and of unit length. The model file of a trained encoder is not available here."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrine.schema import check

DIMENSION, WINDOW = 384, 126


def embed_text(text: str, dimension: int = DIMENSION, window: int = WINDOW) -> np.ndarray:
    """Mean of the windows' means, weighted by their words, at unit length; zeros for no words."""
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    v = np.zeros(dimension, np.float64)
    for at in range(0, len(words), window):
        part = words[at : at + window]
        for term in part + [f"{a} {b}" for a, b in zip(part, part[1:])]:
            h = zlib.crc32(term.encode())
            v[h % dimension] += 1 if h >> 31 else -1
    n = np.sqrt(v @ v)
    return (v / n if n else v).astype(np.float32)


def embed(text: Column, dimension: int = DIMENSION) -> Column:
    check(1 <= dimension <= 65_536, "invalid_dimension")

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else embed_text(t, dimension))

    return run(text)
