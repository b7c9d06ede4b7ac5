"""Exact top-k inner products through a vector-approximation file.

The file holds one byte a component: the cell of a grid laid between the smallest and
largest value of that component over the whole table. A scan of the cells bounds each
inner product from both sides. Of each query the k vectors with the best bounds are read
first; the kth of their exact scores then decides which further vectors must be read, and
those whose bound can't reach it are never read. The result is exact, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.common import int_column, staged

#: Cells a component. Queries a block: what a scanning task holds in memory at once.
CELLS, BLOCK = 256, 8192
#: Whole numbers up to here are exact in a double.
EXACT = float(1 << 53)


def scaled_vectors(rows: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(id, dims, v array<double>): floor(scale * x) of every component x.

    Null keys, null vectors and vectors holding null or non-finite components are left
    out. Of rows that repeat a key, the smallest vector stays.
    """
    x = F.col(vector).cast("array<double>")
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floor = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("double"))
    return (
        rows.where(F.col(key).isNotNull() & sound)
        .select(F.col(key).cast("long").alias("id"), floor.alias("v"))
        .groupBy("id").agg(F.min("v").alias("v"))
        .select("id", F.size("v").alias("dims"), "v")
    )


def grids(vectors: DataFrame) -> DataFrame:
    """(dims, lo, hi): bounds of every component, for each vector length there is."""
    sides = vectors.select("dims", F.posexplode("v").alias("d", "c")).groupBy("dims", "d").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"))
    packed = F.sort_array(F.collect_list(F.struct("d", "lo", "hi")))
    return sides.groupBy("dims").agg(packed.alias("g")).select(
        F.col("dims").alias("grid_dims"), F.col("g.lo").alias("lo"), F.col("g.hi").alias("hi"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _edges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Width of the cells of each component (whole numbers, so that cells hold whole numbers)."""
    return lo, np.maximum(np.ceil((hi - lo + 1) / CELLS), 1)


def cell_file(vectors: DataFrame) -> DataFrame:
    """(id, dims, cells binary, lo, hi): the approximation of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims = int_column(batch, "dims")
            cells: list[bytes] = [b""] * n
            for d in np.unique(dims):
                if d == 0:
                    continue
                at = np.flatnonzero(dims == d)
                part = batch.take(pa.array(at))
                lo, width = _edges(_matrix(part["lo"].slice(0, 1), 1), _matrix(part["hi"].slice(0, 1), 1))
                codes = np.floor((_matrix(part["v"], len(at)) - lo) / width).clip(0, CELLS - 1).astype(np.uint8)
                for i, row in zip(at, codes):
                    cells[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["dims"], pa.array(cells, pa.binary()), batch["lo"], batch["hi"]],
                names=["id", "dims", "cells", "lo", "hi"])

    return vectors.join(grids(vectors), F.col("dims") == F.col("grid_dims"), "left").select("id", "dims", "v", "lo", "hi").mapInArrow(
        run, "id long, dims int, cells binary, lo array<double>, hi array<double>")


def _bounds(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of queries x vectors."""
    lo, width = _edges(lo, hi)
    low = lo + codes * width
    high = np.minimum(low + width - 1, hi)
    middle, half = (low + high) / 2, (high - low) / 2
    # Half steps are exact in binary; far from 2^53 so are the sums, beyond it a relative margin covers rounding.
    about, spread = queries @ middle.T, np.abs(queries) @ half.T
    margin = (np.abs(about) + spread) * 1e-9
    margin[(np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T) < EXACT / 4] = 0
    return about - spread - margin, about + spread + margin


def _kept(best: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """best: a query's k largest lower bounds so far (rows, descending order not needed)."""
    both = np.concatenate([best, low], axis=1)
    return -np.partition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both


def scan(cells: DataFrame, queries: DataFrame, k: int, block: int, ways: int) -> DataFrame:
    """(query_id, vec_id, low, high): all that the cells can't exclude within a share of the rows.

    The queries are cut into blocks and the rows into shares; each pair of them is one
    group of rows, queries first, streamed: a task holds one block of queries and one
    batch of rows. dims is part of the key, as only vectors of one length are comparable.
    """
    blocks = queries.select(F.count(F.lit(1)).alias("n")).select(F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    n_blocks = blocks.scalar()
    asked = queries.select(
        "id", "dims", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("share"), F.lit(0).alias("kind"), F.col("v").alias("q"),
        F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("array<double>").alias("lo"), F.lit(None).cast("array<double>").alias("hi"))
    stored = cells.select(
        "id", "dims", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(ways)).cast("int").alias("share"), F.lit(1).alias("kind"),
        F.lit(None).cast("array<double>").alias("q"), "cells", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, best = None, [], None
        ids = vectors = None

        def flush(candidates: list) -> Iterator[pa.RecordBatch]:
            # A last pass against the final bounds of the share.
            if not candidates:
                return
            q, v, low, high = (np.concatenate(c) for c in zip(*candidates))
            keep = high >= best.min(axis=1)[q] if best.shape[1] == k else np.ones(len(q), bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q[keep]]), pa.array(v[keep]), pa.array(low[keep]), pa.array(high[keep])],
                names=["query_id", "vec_id", "low", "high"])

        found: list = []
        for batch in batches:
            keys = np.stack([int_column(batch, c).astype(np.int64) for c in ("block", "share", "dims", "kind")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), tuple(keys[a][:3])
                if key != group:
                    yield from flush(found)
                    group, held, best, vectors, found = key, [], None, None, []
                if keys[a][3] == 0:
                    held.append((int_column(part, "id"), _matrix(part["q"], b - a)))
                    continue
                if not held:
                    continue
                if vectors is None:
                    ids = np.concatenate([h[0] for h in held])
                    vectors = np.concatenate([h[1] for h in held])
                    best = np.empty((len(ids), 0))
                names = int_column(part, "id")
                codes = np.frombuffer(b"".join(part["cells"].to_pylist()), np.uint8).reshape(len(names), -1)
                lo, hi = _matrix(part["lo"].slice(0, 1), 1), _matrix(part["hi"].slice(0, 1), 1)
                for at in range(0, len(ids), 1024):
                    rows = slice(at, at + 1024)
                    low, high = _bounds(codes, lo, hi, vectors[rows])
                    own = ids[rows, None] == names[None, :]
                    low[own], high[own] = -np.inf, -np.inf
                    if at == 0:
                        fresh = np.empty((len(ids), min(k, best.shape[1] + len(names))))
                    fresh[rows] = _kept(best[rows], low, k)
                    limit = fresh[rows].min(axis=1) if fresh.shape[1] == k else np.full(len(low), -np.inf)
                    q, v = np.nonzero((high >= limit[:, None]) & ~own)
                    found.append((q + at, names[v], low[q, v], high[q, v]))
                best = fresh
        yield from flush(found)

    rows = asked.unionByName(stored).repartition("block", "share", "dims").sortWithinPartitions("block", "share", "dims", "kind")
    return rows.mapInArrow(run, "query_id long, vec_id long, low double, high double")


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs with their exact scores; only here are whole vectors read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, object)
            dims = pa.compute.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                part = batch.take(pa.array(at))
                a, b = _matrix(part["q"], len(at)), _matrix(part["v"], len(at))
                if d == 0:
                    out[at] = 0
                elif (np.abs(a) * np.abs(b)).sum(axis=1).max(initial=0) < EXACT:
                    out[at] = (a * b).sum(axis=1).astype(np.int64)
                else:  # numbers of any size, held to the range of a long
                    for i, x, y in zip(at, a, b):
                        out[i] = sum(int(p) * int(r) for p, r in zip(x, y))
            score = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in out], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["query_id"], batch["vec_id"], pa.array(score)], names=["query_id", "vec_id", "score"])

    joined = pairs.select("query_id", "vec_id").join(
        vectors.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(
        queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return joined.select("query_id", "vec_id", "q", "v").mapInArrow(run, "query_id long, vec_id long, score long")


def nearest(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
    block: int = BLOCK, ways: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose key is divisible by every.

    Scores are inner products of floor(256 * x); ties go to the smaller vec_id. A query
    with fewer than k other vectors of its length has them all; vectors of different
    lengths are not compared. Rows left out and repeated keys: see scaled_vectors. Scores
    beyond a long are held to its range. Other columns are not read; an empty table gives
    an empty result.
    """
    spark = rows.sparkSession
    vectors = staged(scaled_vectors(rows, key, vector), "vectors")
    queries = vectors.where(F.col("id") % every == 0)
    # Of equal vectors only the k + 1 smallest ids can be among the k best of any query.
    copies = Window.partitionBy("v").orderBy("id")
    distinct = vectors.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy")
    cells = staged(cell_file(distinct), "cells")
    ways = ways or int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = staged(scan(cells, queries, k, block, ways), "bounds")
    # The kth lower bound over all shares, then the order in which vectors are read.
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")
    bounds = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    floor = left.withColumn("_r", F.row_number().over(bounds)).where(F.col("_r") == k).select(
        "query_id", F.col("low").alias("kth_low"), F.col("vec_id").alias("kth_id"))
    able = left.join(floor, "query_id", "left").where(
        F.col("kth_low").isNull() | (F.col("high") > F.col("kth_low"))
        | ((F.col("high") == F.col("kth_low")) & (F.col("vec_id") <= F.col("kth_id"))))
    able = staged(able.withColumn("turn", F.row_number().over(order)).select("query_id", "vec_id", "high", "turn"), "turns")
    first = staged(_exact(able.where(F.col("turn") <= k), vectors, queries), "first")
    known = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    later = able.where(F.col("turn") > k).join(known, "query_id").where((F.col("n") < k) | (F.col("high") >= F.col("kth")))
    scored = first.unionByName(_exact(later, vectors, queries))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
