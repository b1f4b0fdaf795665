"""Vectors as array columns."""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_of(vectors: Column) -> Column:
    """Component-wise mean of an array of vectors, as doubles; null for none."""
    none = F.array().cast("array<double>")
    total = F.aggregate(vectors, none, lambda s, v: F.when(F.size(s) == 0, v.cast("array<double>")).otherwise(F.zip_with(s, v, lambda x, y: x + y.cast("double"))))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def model_embedder(load: Callable[[], Callable[[list[str]], Iterable]], batch: int = 64) -> Callable[[Column], Column]:
    """An encoder as a column function: ``load()`` is called once in a worker's task and gives a function from
    a list of sentences to their vectors, which then gets ``batch`` sentences at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in parts:
            said = [t or "" for t in s]
            yield pd.Series([np.asarray(v, np.float32) for i in range(0, len(said), batch) for v in encode(said[i : i + batch])], dtype=object)

    return embed


def hashed_embedder(size: int = 64, n: int = 3):
    """Deterministic unit vectors from hashed character n-grams: the default where no model is given."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(s: pd.Series) -> pd.Series:
        def one(t):
            code = np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
            h = np.zeros(max(0, len(code) - n + 1), np.uint64)
            for i in range(n):
                h = (h ^ code[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            v = np.bincount((h % np.uint64(size)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0), size)
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).astype(np.float32)

        return s.map(one)

    return embed
