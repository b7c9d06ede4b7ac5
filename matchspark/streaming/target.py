"""Partitioned tables that micro-batches change: a batch rewrites only the partitions its keys fall in.

The table is plain Parquet, partitioned by a hash of the key. A batch's result is staged
first, and from there replaces its partitions by dynamic partition overwrite. Each replaced
partition has one row that says which batch of which stream wrote it, so a batch that is
delivered again changes nothing: partitions it has reached are left, and the others are
replaced from what was staged, not computed from a half changed table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the first batch that one partition should hold, and the least number of partitions.
ROWS, LEAST = 250_000, 4
#: Partitions a task may write at once; with more it sorts by them.
OPEN_FILES = 64
OWN = ["_part", "_stream", "_batch", "_parts"]


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table; None before its first batch."""
    stored = _stored(spark, f"{path}/table")
    return None if stored is None else stored.where(F.col("_parts").isNull()).drop(*OWN)


def _markers(stored: DataFrame | None) -> dict[int, tuple[str, int, int]]:
    """What wrote each partition: (stream, batch, number of partitions). One row a partition."""
    if stored is None:
        return {}
    found = stored.where(F.col("_parts").isNotNull()).select(*OWN).collect()
    return {r["_part"]: (r["_stream"], r["_batch"], r["_parts"]) for r in found}


def _replace(staged: DataFrame, path: str) -> None:
    """Replaces the partitions that staged has rows of. A task writes a file of each partition it
    meets, with up to OPEN_FILES open, so that rows are neither shuffled nor sorted for it."""
    conf, before = staged.sparkSession.conf, staged.sparkSession.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    conf.set("spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES)
    try:
        staged.write.mode("overwrite").options(compression="zstd", partitionOverwriteMode="dynamic").partitionBy("_part").parquet(path)
    finally:
        conf.set("spark.sql.maxConcurrentOutputFileWriters", before)


def apply_batch(
    batch: DataFrame, number: int, stream: str, path: str, keys: list[str],
    change: Callable[[DataFrame, DataFrame | None], DataFrame], parts: int | None = None,
) -> bool:
    """One micro-batch into the table at path; False if it had been delivered before.

    change(batch rows, stored rows of the partitions they fall in) gives the new rows of these
    partitions; the stored rows are None before the first batch. stream names the stream
    whose batches are counted, such as its checkpoint. The number of partitions is set by
    the first batch, from its size if not given, and kept (see resize). Names of OWN are the
    table's.
    """
    spark = batch.sparkSession
    batch = batch.persist(StorageLevel.DISK_ONLY)
    try:
        stored = _stored(spark, f"{path}/table")
        wrote = _markers(stored)
        kept = next(iter(wrote.values()))[2] if wrote else parts or max(LEAST, -(-batch.count() // ROWS))
        part = part_of(keys, kept)
        touched = sorted(batch.agg(F.collect_set(part)).first()[0])  # at most one number a partition
        todo = [p for p in touched if p not in wrote or wrote[p][0] != stream or wrote[p][1] < number]
        if not todo:
            return False
        # Two slots, so that what the last batch staged stays until the next one is through.
        slot = f"{path}/staged/slot={number % 2}"
        staged = _stored(spark, slot)
        if staged is None or staged.where((F.col("_stream") == stream) & (F.col("_batch") == number)).isEmpty():
            held = None if stored is None else stored.where(F.col("_part").isin(touched) & F.col("_parts").isNull()).drop(*OWN)
            fresh = change(batch, held).withColumn("_part", part)
            marks = spark.range(1).select(
                F.explode(F.array(*map(F.lit, touched))).alias("_part"), F.lit(stream).alias("_stream"),
                F.lit(number).cast("long").alias("_batch"), F.lit(kept).alias("_parts"))
            fresh = fresh.unionByName(marks, allowMissingColumns=True)
            fresh.write.mode("overwrite").option("compression", "zstd").parquet(slot)
            staged = spark.read.schema(fresh.schema).parquet(slot)
        _replace(staged.where(F.col("_part").isin(todo)), f"{path}/table")
        return True
    finally:
        batch.unpersist()


def resize(spark: SparkSession, path: str, to: str, keys: list[str], parts: int) -> None:
    """The table at path written anew at another place with another number of partitions,
    for tables that have outgrown theirs. Streams go on there after a change of their target."""
    stored = _stored(spark, f"{path}/table")
    newest = stored.where(F.col("_parts").isNotNull()).groupBy("_stream").agg(F.max("_batch").alias("_batch")).orderBy(F.desc("_batch")).first()
    marks = spark.range(parts).select(
        F.col("id").cast("int").alias("_part"), F.lit(newest["_stream"]).alias("_stream"), F.lit(newest["_batch"]).alias("_batch"), F.lit(parts).alias("_parts"))
    moved = stored.where(F.col("_parts").isNull()).withColumn("_part", part_of(keys, parts)).select(stored.columns)
    _replace(moved.unionByName(marks, allowMissingColumns=True), f"{to}/table")
