"""Helpers the operators share: staged tables, worker caches, Arrow columns."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.session import shared_folder

#: White space of all text contracts here: space, and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage is cut, and what a
    lost executor held is read again instead of being computed again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def whole_text(text: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_identity(key: str, text: str) -> Column:
    """One number for a row's key and text; equal rows share it, and they get equal results."""
    return F.xxhash64(F.col(key), whole_text(text))


def one_of_each(docs: DataFrame, key: str, body: Column, keep: DataFrame) -> DataFrame:
    """One row of docs for each row of keep: (_kept_key, _digest), the key (may be null) and
    body's SHA-256 digest, each pair once.

    Rows that repeat a pair are merged in the task that reads them and then globally; of
    those that differ in other columns, the one with the least hash stays.
    """
    # No null and one type, so that the join meets rows where the aggregation has put them.
    named = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), named(key).alias("_pair_key"), F.sha2(body, 256).alias("_digest"))
    # Maps can't be hashed as they are.
    whole = F.to_json("_row") if "map<" in rows.schema["_row"].dataType.simpleString() else F.col("_row")
    single = rows.groupBy("_digest", "_pair_key").agg(F.min_by("_row", F.xxhash64(whole)).alias("_row"))
    wanted = keep.select("_digest", named("_kept_key").alias("_pair_key"))
    return single.join(wanted, ["_digest", "_pair_key"], "left_semi").select("_row.*")


def worker_value(key: Hashable, make: Callable[[], Any]) -> Any:
    """make() once in each worker process. Functions travel by value, so a module's own
    globals would not outlive a task."""
    store = vars(sys).setdefault("_matchspark_worker_values", {})
    if key not in store:
        store[key] = make()
    return store[key]


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.view(kind).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: Arrow batches of whole texts may be large."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def int_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def with_columns(batch: pa.RecordBatch, drop: set[str], **added: pa.Array) -> pa.RecordBatch:
    """batch without the dropped columns, with others behind."""
    names = [n for n in batch.schema.names if n not in drop]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *added.values()], names=[*names, *added])
