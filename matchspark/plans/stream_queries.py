"""Streaming forms, run to the end of the available files; each equals its batch result."""

import uuid

from pyspark.sql import functions as F

from matchspark.functions import text
from matchspark.operators import incremental
from matchspark.plans.registry import query
from matchspark.session import shared_folder
from matchspark.sources import tables
from matchspark.streaming import ingest, target


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _arriving(spark, folder, batches, run) -> None:
    """Files that arrive one lot after the other; run(stream) handles each lot as one
    micro-batch, and goes on from its checkpoint."""
    for batch in batches:
        batch.write.mode("append").option("compression", "zstd").parquet(f"{folder}/arrived")
        run(ingest.read_stream(spark, f"{folder}/arrived", batch.schema))


def _twice(each):
    """A batch writer to which every batch is delivered again, as after a failure."""
    def deliver(batch, number):
        each(batch, number)
        each(batch, number)

    return deliver


def _thirds(spark, sf, name, key, *columns):
    """A table in three lots: later and earlier rows mixed, the first third repeated at the end."""
    rows = tables.read_table(spark, sf, name).select(*columns)
    parts = [rows.where(F.pmod(F.col(key), F.lit(3)) == n) for n in range(3)]
    return [*parts, parts[0]]


def _by_time(spark, sf, *columns):
    """Events about as they happened: three lots that overlap, and with the last one copies
    of the first days, which are too late by then."""
    rows = tables.read_table(spark, sf, "events").select(*columns, F.col("ts").cast("timestamp").alias("ts"))
    day = F.dayofmonth("ts")
    return [rows.where(day < 12), rows.where((day >= 8) & (day < 22)), rows.where((day >= 20) | (day < 4))]


DELAY = "5 days"


SQL_NEWEST = """
    SELECT event_id, user_id, event_type, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
"""


@query("stream_latest", SQL_NEWEST)
def stream_latest(spark, sf):
    """The newest version in a table that every batch is merged into; the stream has no state."""
    folder = _folder(spark)
    each = ingest.upsert(f"{folder}/latest", ["user_id", "event_type"], ["ts", "event_id"], folder)
    lots = _thirds(spark, sf, "events", "event_id", "event_id", "user_id", "event_type", "ts")
    _arriving(spark, folder, lots, lambda events: ingest.run_available(events, each, f"{folder}/checkpoint"))
    return target.rows(spark, f"{folder}/latest")


@query("stream_newest", SQL_NEWEST)
def stream_newest(spark, sf):
    """Only rows newer than all before pass; late ones are dropped, and a watermark bounds the state."""
    folder, before = _folder(spark), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    each = ingest.upsert(f"{folder}/newest", ["user_id", "event_type"], ["ts", "event_id"], folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.STATE_STORE)
    try:
        _arriving(spark, folder, _by_time(spark, sf, "event_id", "user_id", "event_type"), lambda events: ingest.run_available(
            ingest.newest_stream(events, ["user_id", "event_type"], "ts", "event_id", DELAY), each, f"{folder}/checkpoint"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return target.rows(spark, f"{folder}/newest").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_dedup", """
    SELECT event_id, user_id, ts FROM events
""")
def stream_dedup(spark, sf):
    """Copies that arrive again within the delay are dropped; a watermark bounds the state."""
    folder = _folder(spark)
    rows = tables.read_table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    _arriving(spark, folder, [rows, rows], lambda events: ingest.run_available(
        ingest.dedup_stream(events, ["event_id"], "ts", "60 days"),
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/checkpoint"))
    found = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return found.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_activity", "SELECT user_id, max(ts) AS date_last_active FROM events GROUP BY user_id")
def stream_activity(spark, sf):
    folder = _folder(spark)
    each = ingest.upsert(f"{folder}/activity", ["user_id"], ["date_last_active"], folder)
    _arriving(spark, folder, _by_time(spark, sf, "user_id"), lambda events: ingest.run_available(
        ingest.last_activity_stream(events, "user_id", "ts", DELAY), each, f"{folder}/checkpoint", mode="update"))
    return target.rows(spark, f"{folder}/activity").select("user_id", F.col("date_last_active").cast("timestamp_ntz").alias("date_last_active"))


@query("stream_merge", r"""
    SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_words,
        doc_id % 3 <> 0 AS needs_processing
    FROM documents WHERE trim(text) <> ''
""")
def stream_merge(spark, sf):
    """All documents, then changed texts of every second one, then every third one as it is."""
    folder = _folder(spark)
    key, body = F.col("doc_id"), F.col("text")
    rows = tables.read_table(spark, sf, "documents").where(text.not_blank(body))
    newer = F.when(key % 2 == 0, F.concat(body, F.lit(" changed"))).otherwise(body)
    batches = [rows.select("doc_id", body.alias("description")), rows.where(key % 2 == 0).select("doc_id", newer.alias("description")),
               rows.where(key % 3 == 0).select("doc_id", newer.alias("description"))]
    named = lambda docs: docs.select(
        "doc_id", "description", F.col("description").alias("description_raw"), F.lit(None).cast("string").alias("jobtitle"))

    def transform(batch, previous):
        detected = incremental.detect_vacancies(batch, previous, key="doc_id")
        count_words = lambda rows: rows.withColumn("n_words", F.size(text.tokens(F.col("description"))))
        return incremental.reprocess(
            detected, "needs_processing", count_words, ["n_words"], F.lit("2024-02-01").cast("timestamp_ntz"))

    each = _twice(ingest.merge(f"{folder}/merged", "doc_id", transform, folder))
    _arriving(spark, folder, batches, lambda docs: ingest.run_available(named(docs), each, f"{folder}/checkpoint"))
    return target.rows(spark, f"{folder}/merged").select("doc_id", "n_words", "needs_processing")


@query("stream_search_refresh", r"""
    SELECT doc_id, token, count(*) AS tf, CAST(any_value(doc_len) AS INTEGER) AS doc_len FROM (
        SELECT doc_id, unnest(words) AS token, len(words) AS doc_len FROM (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents))
    GROUP BY doc_id, token
""")
def stream_search_refresh(spark, sf):
    folder = _folder(spark)
    first, second, third, again = _thirds(spark, sf, "documents", "doc_id", "doc_id", "text")
    # The first third arrives with other texts, which the last batch replaces.
    older = first.withColumn("text", F.concat(F.lit("older "), "text"))
    each = ingest.refresh_postings(f"{folder}/postings", "doc_id", "text", folder)
    _arriving(spark, folder, [older, second, third, again], lambda docs: ingest.run_available(docs, each, f"{folder}/checkpoint"))
    return target.rows(spark, f"{folder}/postings")
