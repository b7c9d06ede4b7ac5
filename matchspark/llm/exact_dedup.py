"""Exact duplicates by skew-safe combining.

Three rounds, each comparing whole texts: every task merges the equal texts it has read
(the map side of the first aggregation), equal texts of one salt meet, and the winners
of the salts meet. A text that a third of all rows share reaches the first shuffle as one
row for each task and salt and the second as one row for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import SPACE, one_of_each, whole_text

SALTS = 16


def _body(text: str) -> Column:
    return F.regexp_replace(whole_text(text), SPACE, " ")


def _bodies(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("_key"), _body(text).alias("_body"))
    return rows.withColumn("text_sha256", F.sha2("_body", 256))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """text_sha256, _second, keep_id, group_size: one row per text."""
    salted = (
        rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)))
        .groupBy("text_sha256", "_salt", "_body")
        .agg(F.min("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return (
        salted.groupBy("text_sha256", "_body")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        # A second digest tells texts apart should two ever share the first.
        .select("text_sha256", F.xxhash64("_body").alias("_second"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each white-space run is one space; null
    counts as empty. The smallest key of a group stays. A null key never beats another; a
    group of null keys only has keep_id null and all its rows kept. Rows that repeat the
    winning key with the same text all count as kept. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = _bodies(docs, key, text)
    winners = _winners(rows, salts)
    return (
        rows.select("_key", "text_sha256", F.xxhash64("_body").alias("_second"))
        .join(winners, ["text_sha256", "_second"])
        .select(
            F.col("_key").alias(key), "keep_id", "group_size",
            F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """docs with one row of each group of equal texts: one with the smallest key.

    Of rows that repeat the smallest key with that text one stays, and of a group of null
    keys only one row too.
    """
    winners = _winners(_bodies(docs, key, text), salts)
    keep = winners.select(F.col("text_sha256").alias("_digest"), F.col("keep_id").alias("_kept_key"))
    return one_of_each(docs, key, _body(text), keep)
