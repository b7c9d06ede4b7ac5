"""Versioned notes and the chat threads built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = " || "


def latest_version(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. The rank limit is applied before the shuffle as well,
    so a key with very many versions sends one row per task."""
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.withColumn("_version", F.row_number().over(newest_first))
        .where(F.col("_version") == 1)
        .drop("_version")
    )


def live_notes(notes: DataFrame, action: str, question: str) -> DataFrame:
    """Latest versions that are not deleted and hold the wanted question.
    Deletion is tested after the version pick: a deleted latest version removes the note."""
    latest = latest_version(notes, ["noteid"], ["load_datetimestamp", "comments"])
    return latest.where(
        (F.col("isdeleted") == 0)
        & F.col("action").ilike(f"%{action}%")
        & F.col("comments").ilike(f"%{question}%")
    )


def threads(df: DataFrame, key: str, text: str, order: list[str], chunk: Column, out: str) -> DataFrame:
    """Join the texts of a key in order.

    Two levels: the texts are first joined per (key, chunk), where chunk must
    grow with the order, then the chunk strings per key. One busy key is thereby
    sorted by many tasks, and the last step sees one row per chunk.
    """
    def joined(column: str, by: list[str]) -> str:
        return f"listagg({column}, '{SEPARATOR}') within group (order by {', '.join(by)})"

    return (
        df.where(F.col(text).isNotNull())
        .withColumn("_chunk", chunk)
        .groupBy(key, "_chunk")
        .agg(F.expr(joined(text, order)).alias("_part"))
        .groupBy(key)
        .agg(F.expr(joined("_part", ["_chunk"])).alias(out))
    )


def chat_threads(notes: DataFrame, action: str, question: str) -> DataFrame:
    return threads(
        live_notes(notes, action, question).withColumnRenamed("personreferenceid", "candidateid"),
        "candidateid", "comments", ["load_datetimestamp", "noteid"],
        F.date_trunc("month", "load_datetimestamp"), "chatwa",
    )


def with_threads(candidates: DataFrame, chats: DataFrame) -> DataFrame:
    return candidates.join(chats.select("candidateid", "chatwa"), "candidateid", "left")
