"""Vector expressions and a deterministic text embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions.text import tokens

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero for zero vectors, null for null ones."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON))


def min_scale(x: Column, low: Column) -> Column:
    """Map [low, 1] to [0, 1]."""
    return (x - low) / (F.lit(1.0) - low + F.lit(EPSILON))


def or_placeholder(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(vocab.NO_TEXT)).otherwise(c)


def hash_buckets(c: Column, dims: int) -> Column:
    """One bucket per token of the text, from the token's md5."""
    return F.transform(
        tokens(c),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"),
    )


def hash_embedding(c: Column, dims: int = 1024) -> Column:
    """Unit-length token-count vector of a text.

    Tokens and buckets are JVM expressions; the worker only counts integers per
    row and scales, on Arrow batches.
    """

    @F.pandas_udf("array<float>")
    def pack(buckets: pd.Series) -> pd.Series:
        # One count over (row, bucket) for the whole batch.
        sizes = buckets.str.len().to_numpy(np.int64)
        ids = np.concatenate([*buckets.to_numpy(), np.empty(0, np.int64)]).astype(np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(rows * dims + ids, minlength=len(sizes) * dims).reshape(len(sizes), dims)
        length = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        return pd.Series(list((counts / np.where(length == 0, 1, length)).astype(np.float32)))

    return pack(hash_buckets(or_placeholder(c), dims))
