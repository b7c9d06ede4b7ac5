"""Document quality by regularised quadratic discriminant analysis.

Statistics of a document (shares of kinds of characters, repetition of words, word pairs and
lines, lengths) are smoothed towards a typical text, so that short texts are not extreme,
and logged. Each class has a mean and a covariance that is shrunk towards the pooled one;
the score is the logistic of the difference of the two log densities, whose Mahalanobis
distances come from Cholesky factors made once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import free_name, row_identity, staged, texts_of, whole_text

SHRINK, RIDGE, FAR = 0.3, 1e-3, 8.0
THRESHOLD = 0.3
#: Characters and words of typical text that every text is mixed with.
CHARS, WORDS = 200.0, 40.0
N = 14


def statistics(body: bytes) -> list[float]:
    """Transformed statistics of one UTF-8 text, of N numbers; empty texts give those of typical text."""
    kinds = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    total, words = len(body), body.split()
    n = len(words)
    upper, lower, high, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[128:].sum(), kinds[48:58].sum()
    space = kinds[9:14].sum() + kinds[32]
    lines = [x for x in body.split(b"\n") if x]
    counts = Counter(words)

    def of_chars(x: float, typical: float) -> float:
        return math.log((x + CHARS * typical) / (total + CHARS))

    def of_words(x: float, typical: float) -> float:
        return math.log((x + WORDS * typical) / (n + WORDS))

    return [
        of_chars(upper, 0.03),
        of_chars(digits, 0.005),
        of_chars(total - upper - lower - high - digits - space, 0.03),
        of_chars(kinds[44] + kinds[46], 0.025),
        of_chars(kinds[33] + kinds[63], 0.002),
        of_chars(kinds[[35, 36, 37, 38, 42, 124]].sum(), 0.002),
        of_chars(high, 0.03),
        of_words(n - len(counts), 0.3),
        of_words(max(counts.values(), default=0), 0.06),
        of_words(max(n - 1 - len(set(zip(words, words[1:]))), 0), 0.03),
        of_words(len(lines), 0.08),
        math.log((len(lines) - len(set(lines)) + 0.2) / (len(lines) + 4)),
        math.log((total - space + 5.0 * WORDS) / (n + WORDS)),
        of_words(sum(w[-1] in b".,!?;:" for w in words), 0.12),
    ]


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rid, x): the statistics of every row."""
    rows = docs.select(F.col(key), row_identity(key, text).alias("rid"), whole_text(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch, "_text")], float).reshape(-1)
            offsets = np.arange(0, len(x) + 1, N, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch[key], batch["rid"], pa.ListArray.from_arrays(offsets, pa.array(x))], names=[key, "rid", "x"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, rid long, x array<double>")


def fold(key: str, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo the number of folds; 0 is held out. A null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class Model:
    """Means and inverse Cholesky factors of both classes, over standardised statistics."""

    centre: np.ndarray
    width: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.width, -FAR, FAR)
        density = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """A model from each class's count, sums and sums of products.

    A class with few rows is shrunk further; one with none has the other's place and
    spread, and only its prior (counts plus one half) differs.
    """
    n = sum(m[0] for m in moments.values())
    if n == 0:
        zero, one = np.zeros(N), np.eye(N)
        return Model(zero, np.ones(N), [zero, zero], [one, one], [0.0, 0.0])
    total, products = sum(m[1] for m in moments.values()), sum(m[2] for m in moments.values())
    centre = total / n
    width = np.sqrt(np.maximum(np.diag(products) / n - centre**2, 1e-6))

    def spread(count: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = sums / count
        return (mean - centre) / width, (squares / count - np.outer(mean, mean)) / np.outer(width, width)

    parts = {k: spread(*m) for k, m in moments.items() if m[0] > 0}
    pooled = sum(moments[k][0] * c for k, (_, c) in parts.items()) / n
    means, factors, offsets = [], [], []
    for k in (0, 1):
        count = moments[k][0] if k in moments else 0.0
        mean, own = parts.get(k, (np.zeros(N), pooled))
        share = max(shrink, N / (N + count))
        cover = (1 - share) * own + share * pooled + ridge * np.eye(N)
        lower = np.linalg.cholesky(cover)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log((count + 0.5) / (n + 1)) - float(np.log(np.diag(lower)).sum()))
    return Model(centre, width, means, factors, offsets)


def learn(rows: DataFrame, labels: DataFrame, key: str, label: str) -> Model:
    """A model from all labelled rows outside fold 0. Only some hundred sums reach the driver."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_label_key"), F.col(label).alias("_class")).distinct()
    x = [F.element_at("x", i + 1) for i in range(N)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(N) for j in range(i, N)]
    found = (
        rows.where(fold(key) != 0).join(known, F.col(key) == F.col("_label_key"))
        .groupBy("_class").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()
    )
    moments = {}
    for r in found:
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(N)] for i in range(N)], float)
        moments[int(r["_class"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(N)], float), p)
    return fit(moments)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of docs: key, rid, score (0 to 1, higher: class 1 likelier).

    Statistics are taken once, of whole texts; a null text is empty. The key only finds
    labels and the fold. Labels other than 0 and 1 are not used, repeated ones count once;
    without any label every score is a half. An empty table gives an empty result.
    """
    rows = staged(measured(docs, key, text), "statistics")
    model = learn(rows, labels, key, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, N)
            yield pa.RecordBatch.from_arrays([batch[key], batch["rid"], pa.array(model.score(x))], names=[key, "rid", "score"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, rid long, score double")


def predicted(threshold: float = THRESHOLD) -> Column:
    return (F.col("score") >= threshold).cast("int")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, labels).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", predicted().alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold."""
    rid = free_name(docs, "_rid")
    good = score(docs, labels, key, text).where(F.col("score") >= threshold).select(F.col("rid").alias(rid)).distinct()
    return docs.withColumn(rid, row_identity(key, text)).join(good, rid, "left_semi").select(docs.columns)
