"""Freshness as micro-batches: files that arrived since the last run are processed once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchspark.operators import search
from matchspark.operators.notes import latest_version
from matchspark.sources import tables
from matchspark.streaming.target import apply_batch

#: Keeps state on disk, as states with timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of a batch that are sent to the stored rows; with more, both are shuffled.
SENT_KEYS = 2_000_000
#: Buckets of keys whose versions a stream holds, and slots of a bucket.
KEY_BUCKETS, KEY_SLOTS = 1024, 16
#: Documents tokenised by one task, whose words it counts in memory.
TOKENISED = 4_000


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> list[dict]:
    """Process what is there and stop; a rerun continues after the last finished batch.
    Gives the progress of the batches, with the sizes of their state."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return list(query.recentProgress)


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First arrival per key; state older than the delay is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class _Newest(StatefulProcessor):
    """Holds the version of each key's newest row until the watermark is past it by the delay.

    Python is called once per bucket of keys and batch, and reads and writes a slot of keys at a
    time: calls for single keys cost a thousand times what their work does.
    """

    def __init__(self, names: list[str], tie: str, tie_type: str, delay_ms: int):
        self.names, self.tie, self.delay_ms = names, tie, delay_ms
        self.whole = tie_type in ("tinyint", "smallint", "int", "bigint")
        self.state_schema = f"held array<struct<key: string, at: bigint, tie: {tie_type}>>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", self.state_schema)

    def newest(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The newest row per key; a missing tie is older than any."""
        return rows.sort_values(["_at", self.tie], na_position="first").drop_duplicates("_key", keep="last")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self._reduced(rows)
        asked: dict[int, list[tuple]] = {}
        for i, (slot, name, at, tie) in enumerate(zip(*(best[c].to_numpy() for c in ("_slot", "_key", "_at", self.tie)))):
            # Whole numbers beside nulls come as floats, which the state would hold as null.
            tie = None if pd.isna(tie) else int(tie) if self.whole else tie.item() if hasattr(tie, "item") else tie
            asked.setdefault(int(slot), []).append((i, name, (int(at), tie)))
        known, fresh = self.slots.exists(), []
        for slot, versions in asked.items():
            found = self.slots.getValue((slot,)) if known else None
            held = {name: (at, tie) for name, at, tie in found[0]} if found else {}
            later = [(i, name, version) for i, name, version in versions if name not in held or _later(version, held[name])]
            if later:
                held.update((name, version) for _, name, version in later)
                self._put(slot, held)
                fresh += [i for i, _, _ in later]
        if fresh:
            newer = best.iloc[fresh]
            self._wake(int(newer["_at"].min()))
            yield newer

    def _reduced(self, parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The newest row per key of all parts; about twice the keys' number of rows is held."""
        held, n, size = [], 0, 0
        for part in parts:
            # Computed columns come without their names.
            part = part.set_axis(self.names, axis=1)
            if part["_at"].isna().any():
                raise ValueError("a row without a time has no place among the versions")
            held.append(self.newest(part))
            n += len(held[-1])
            if len(held) > 1 and n > 2 * size:
                held = [self.newest(pd.concat(held))]
                n = size = len(held[0])
        return held[0] if len(held) == 1 else self.newest(pd.concat(held))

    def _put(self, slot: int, held: dict[str, tuple]) -> None:
        self.slots.updateValue((slot,), ([(name, *version) for name, version in held.items()],))

    def _wake(self, oldest: int) -> None:
        """A timer for the oldest version, on a grid: a bucket is looked through some times per delay, not per key."""
        step = max(1, self.delay_ms // 4)
        self.handle.registerTimer(-(-(oldest // 1000 + self.delay_ms) // step) * step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # No version is without a timer: that of its batch, or the one set here when it went off.
        until, left = expiredTimerInfo.getExpiryTimeInMs() - self.delay_ms, []
        for (slot,), (found,) in list(self.slots.iterator()) if self.slots.exists() else []:
            held = {name: (at, tie) for name, at, tie in found if at // 1000 > until}
            left += [at for at, _ in held.values()]
            if not held:
                self.slots.removeKey((slot,))
            elif len(held) < len(found):
                self._put(slot, held)
        if left:
            self._wake(min(left))
        return iter([])

    def close(self) -> None:
        pass


def _later(version: tuple, held: tuple) -> bool:
    (at, tie), (held_at, held_tie) = version, held
    return at > held_at or (at == held_at and tie is not None and (held_tie is None or tie > held_tie))


def _key_text(rows: DataFrame, keys: list[str]) -> Column:
    """The values of a key (of plain types) as one text, different for different keys; null differs from every text."""
    exact = {"binary": F.hex, "timestamp": F.unix_micros}
    return F.to_json(F.array(*[exact.get(dict(rows.dtypes)[k], lambda c: c)(F.col(k)).cast("string") for k in keys]), {"ignoreNullFields": "false"})


def newest_stream(stream: DataFrame, keys: list[str], ts: str, tie: str, delay: str,
                  buckets: int = KEY_BUCKETS, slots: int = KEY_SLOTS) -> DataFrame:
    """Rows that are newer (by ts, then tie) than every earlier row of their key.

    Rows older than the watermark are dropped. A key's state is one version number, and goes
    when the watermark is the delay past it, or up to a quarter of the delay later: whatever
    comes for the key after that is newer than what was forgotten, or too late. Keys are dealt
    by hash into buckets, as many as tasks can work at once, and each bucket's into slots, which
    are read and written whole; both numbers must stay for a checkpoint. Needs the state store
    STATE_STORE.
    """
    delay_ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    rows = stream.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark(ts, delay)
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets * slots))
    rows = rows.withColumns({"_key": _key_text(rows, keys), "_bucket": (place % buckets).cast("int"), "_slot": F.floor(place / buckets).cast("int")})
    newest = _Newest(rows.columns, tie, stream.schema[tie].dataType.simpleString(), delay_ms)
    found = rows.groupBy("_bucket").transformWithStateInPandas(newest, rows.schema, "Append", "EventTime")
    return found.select(stream.columns)


def last_activity_stream(stream: DataFrame, key: str, ts: str, delay: str, width: str = "1 day") -> DataFrame:
    """Last activity of a key in each window of time; a window's state goes when the watermark
    is past its end. Merged by key into a table (see upsert) the newest is the last activity."""
    windows = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), F.col(key))
    return windows.agg(F.max(ts).alias("date_last_active")).select(key, "date_last_active")


def upsert(target: str, keys: list[str], order: list[str], stream: str) -> Callable[[DataFrame, int], None]:
    """Batch writer keeping the newest row per key; only partitions the batch falls in are
    read and rewritten, and a batch that is delivered again changes nothing."""
    def change(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        return latest_version(batch if stored is None else stored.unionByName(batch), keys, order)

    return lambda batch, number: apply_batch(batch, number, stream, target, keys, change) and None


def _keys_of(batch: DataFrame, key: str) -> DataFrame:
    keys = batch.select(key).distinct()
    return F.broadcast(keys) if batch.count() <= SENT_KEYS else keys


def merge(target: str, key: str, transform: Callable[[DataFrame, DataFrame | None], DataFrame], stream: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for change detection: transform(batch, previous rows of its keys)
    gives the new rows; rows of other keys in the touched partitions are kept."""
    def change(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        if stored is None:
            return transform(batch, None)
        keys = _keys_of(batch, key)
        fresh = transform(batch, stored.join(keys, key, "left_semi"))
        untouched = stored.join(keys, key, "left_anti")
        return fresh.unionByName(tables.align(untouched, fresh.schema))

    return lambda batch, number: apply_batch(batch, number, stream, target, [key], change) and None


def refresh_postings(target: str, key: str, text: str, stream: str) -> Callable[[DataFrame, int], None]:
    """Batch writer replacing the postings of the documents in the batch."""
    def change(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        tasks = max(batch.sparkSession.sparkContext.defaultParallelism, -(-batch.count() // TOKENISED))
        fresh = search.postings(batch, key, text, tasks)
        return fresh if stored is None else stored.join(_keys_of(batch, key), key, "left_anti").unionByName(fresh)

    return lambda batch, number: apply_batch(batch, number, stream, target, [key], change) and None
