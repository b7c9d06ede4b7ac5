"""Streams: batches delivered again or broken off, late rows, bounded state."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.streaming import ingest, target

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.LongType()), T.StructField("text", T.StringType())])


def rows_of(spark, path):
    return sorted(map(tuple, target.rows(spark, path).select("k", "t", "text").collect()))


def test_streams_continue_where_they_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(name, each):
        stream = ingest.read_stream(spark, source, SCHEMA, files_per_batch=1)
        ingest.run_available(stream, each, f"{out}/{name}-checkpoint")

    latest = ingest.upsert(f"{out}/latest", ["k"], ["t"], "s")
    index = ingest.refresh_postings(f"{out}/index", "k", "text", "s")
    arrive([(1, 1, "red ring"), (2, 5, "bolt")])
    run("latest", latest), run("index", index)
    arrive([(1, 3, "red"), (2, 4, "nut nut")])
    run("latest", latest), run("index", index), run("latest", latest)
    assert rows_of(spark, f"{out}/latest") == [(1, 3, "red"), (2, 5, "bolt")]
    got = sorted((r["k"], r["token"], r["tf"]) for r in target.rows(spark, f"{out}/index").collect())
    assert got == [(1, "red", 1), (2, "nut", 2)]


def test_a_partition_that_loses_all_rows_is_emptied(spark, tmp_path):
    index = ingest.refresh_postings(str(tmp_path / "index"), "k", "text", "s")
    index(spark.createDataFrame([(1, 1, "red")], SCHEMA), 0)
    index(spark.createDataFrame([(1, 2, "...")], SCHEMA), 1)
    assert target.rows(spark, str(tmp_path / "index")).count() == 0


def counting(batch, stored):
    """A change that is not idempotent: t counts how often a key was changed."""
    new = batch.select("k", "text")
    if stored is None:
        return new.select("k", F.lit(1).cast("long").alias("t"), "text")
    changed = stored.join(new.select("k"), "k", "left_semi").withColumn("t", F.col("t") + 1)
    unknown = new.join(stored.select("k"), "k", "left_anti").select("k", F.lit(1).cast("long").alias("t"), "text")
    return changed.unionByName(stored.join(new.select("k"), "k", "left_anti")).unionByName(unknown)


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(k, 0, "x") for k in range(40)], SCHEMA)
    half = batch.where("k < 20")
    apply = lambda rows, number, stream="s": target.apply_batch(rows, number, stream, path, ["k"], counting)
    assert apply(batch, 0) and not apply(batch, 0)
    assert apply(half, 1) and not apply(half, 1) and not apply(half, 0)
    assert rows_of(spark, path) == [(k, 2 if k < 20 else 1, "x") for k in range(40)]
    # Another stream counts its own batches.
    assert apply(half, 0, "other") and not apply(half, 0, "other")
    assert rows_of(spark, path) == [(k, 3 if k < 20 else 1, "x") for k in range(40)]
    assert not apply(batch.limit(0), 7)


def test_a_batch_broken_off_is_finished_from_what_was_staged(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(k, 0, "x") for k in range(40)], SCHEMA)
    target.apply_batch(batch, 0, "s", path, ["k"], counting)
    whole = target._replace

    def half(staged, at):
        whole(staged.where("_part < 2"), at)
        raise RuntimeError("lost")

    monkeypatch.setattr(target, "_replace", half)
    with pytest.raises(RuntimeError):
        target.apply_batch(batch, 1, "s", path, ["k"], counting)
    monkeypatch.setattr(target, "_replace", whole)
    assert {t for _, t, _ in rows_of(spark, path)} == {1, 2}
    never = lambda batch, stored: pytest.fail("computed again from a half changed table")
    assert target.apply_batch(batch, 1, "s", path, ["k"], never)
    assert rows_of(spark, path) == [(k, 2, "x") for k in range(40)]


def test_resize(spark, tmp_path):
    batch = spark.createDataFrame([(k, 0, "x") for k in range(40)], SCHEMA)
    target.apply_batch(batch, 3, "s", str(tmp_path / "a"), ["k"], counting, parts=2)
    target.resize(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["k"], 7)
    assert rows_of(spark, str(tmp_path / "b")) == rows_of(spark, str(tmp_path / "a"))
    assert not target.apply_batch(batch, 3, "s", str(tmp_path / "b"), ["k"], counting)
    assert target.apply_batch(batch, 4, "s", str(tmp_path / "b"), ["k"], counting)
    assert {t for _, t, _ in rows_of(spark, str(tmp_path / "b"))} == {2}


def run_lots(spark, tmp_path, lots, make, each, mode="append"):
    """Lots of (k, seconds, text) arrive and are handled one after the other."""
    progress = []
    for lot in lots:
        rows = spark.createDataFrame(lot, "k long, s long, text string").select("k", F.timestamp_seconds("s").alias("ts"), "text", F.col("s").alias("id"))
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(ingest.read_stream(spark, str(tmp_path / "in"), rows.schema))
        progress += ingest.run_available(stream, each, str(tmp_path / "checkpoint"), mode)
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


DAY = 86_400


def test_newest_on_a_stream_with_late_rows_and_bounded_state(spark, tmp_path):
    lots = [[(k, DAY * 10 + k, "old") for k in range(30)] + [(0, DAY * 10, "older"), (0, DAY * 10, "older")],
            [(1, DAY * 10 + 500, "newer"), (1, DAY * 10 - 9, "older"), (2, DAY * 10 + 2, "same")],
            [(99, DAY * 20, "far on")],
            [(3, DAY * 10 + 900, "too late"), (4, DAY * 20 + 5, "after its state had gone")]]
    seen = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.STATE_STORE)
    try:
        held = run_lots(spark, tmp_path, lots, lambda s: ingest.newest_stream(s, ["k"], "ts", "id", "1 day"),
                        lambda batch, _: seen.extend((r["k"], r["id"], r["text"]) for r in batch.collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(seen) == sorted([(k, DAY * 10 + k, "old") for k in range(30)] + [
        (1, DAY * 10 + 500, "newer"), (99, DAY * 20, "far on"), (4, DAY * 20 + 5, "after its state had gone")])
    # 30 keys at first; when the watermark is a day past them only the new ones are held.
    assert max(held) == 31 and held[-1] <= 2


class FakeSlots:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return bool(self.held)

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.held[key]

    def iterator(self):
        return iter(self.held.items())


def test_newest_works_on_slots_of_keys_not_on_single_keys():
    """Thousands of keys cost as many state calls as there are slots, in any number of batches."""
    slots, timers = FakeSlots(), []
    newest = ingest._Newest(["k", "_at", "id", "_key", "_slot"], "id", "bigint", 1000)
    newest.init(SimpleNamespace(getMapState=lambda *_: slots, registerTimer=timers.append))
    rng, best = random.Random(3), {}
    for lot in range(3):
        rows = [(k := rng.randrange(3000), rng.randrange(lot * 10**6, 3 * 10**6), rng.randrange(9), str(k), k % 8) for _ in range(6000)]
        found = [r for part in newest.handleInputRows((0,), iter([pd.DataFrame(rows[:2500]), pd.DataFrame(rows[2500:])]), None) for r in part.itertuples(index=False)]
        wanted = {}
        for k, at, tie, *_ in rows:
            if (at, tie) > best.get(k, (-1, -1)):
                best[k] = wanted[k] = (at, tie)
        assert {r.k: (r._1, r.id) for r in found} == wanted and len(found) == len(wanted)
    assert slots.calls <= 3 * 2 * 8 and len(timers) == 3
    newest.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: 3500))
    left = {int(name): (at, tie) for (found,) in slots.held.values() for name, at, tie in found}
    assert left == {k: v for k, v in best.items() if v[0] // 1000 + 1000 > 3500} and 0 < len(left) < len(best)
    assert len(timers) == 4 and timers[-1] >= min(at for at, _ in left.values()) // 1000 + 1000
    newest.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: 9000))
    assert not slots.held and len(timers) == 4


def test_newest_on_a_stream_with_null_and_similar_keys(spark, tmp_path):
    rng, best, wanted, seen = random.Random(5), {}, [], []
    pairs = [(None, None), (1, None), (None, "1"), (1, "1"), (11, ""), (1, "1,"), (2, "null"), (2, None), (2, "")]
    schema = "a long, b string, s long, id long"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.STATE_STORE)
    try:
        for _ in range(2):
            lot = [(*rng.choice(pairs), DAY * 10 + rng.randrange(40), rng.choice([None, 1, 2, 3])) for _ in range(60)]
            fresh = {}
            for a, b, s, tie in lot:
                if (s, tie or 0) > best.get((a, b), (0, 0)):
                    best[a, b] = fresh[a, b] = (s, tie or 0)
            wanted += [(*key, *version) for key, version in fresh.items()]
            rows = spark.createDataFrame(lot, schema).select("a", "b", F.timestamp_seconds("s").alias("ts"), "id")
            rows.write.mode("append").parquet(str(tmp_path / "in"))
            stream = ingest.newest_stream(ingest.read_stream(spark, str(tmp_path / "in"), rows.schema), ["a", "b"], "ts", "id", "1 day", buckets=2, slots=2)
            assert stream.columns == ["a", "b", "ts", "id"]
            ingest.run_available(stream, lambda batch, _: seen.extend(
                (r["a"], r["b"], r["s"], r["id"] or 0) for r in batch.withColumn("s", F.unix_seconds("ts")).collect()), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(seen, key=repr) == sorted(wanted, key=repr)


def test_activity_by_windows_has_bounded_state(spark, tmp_path):
    lots = [[(k, DAY * d + k, "") for k in range(20) for d in (first, first + 1)] for first in (10, 14, 18, 22)]
    lots[-1] += [(0, DAY * 3, "far too late")]
    each = ingest.upsert(str(tmp_path / "out"), ["k"], ["date_last_active"], "s")
    held = run_lots(spark, tmp_path, lots, lambda s: ingest.last_activity_stream(s, "k", "ts", "1 day"), each, "update")
    got = {r["k"]: r["t"] for r in target.rows(spark, str(tmp_path / "out")).select("k", F.unix_seconds("date_last_active").alias("t")).collect()}
    assert got == {k: DAY * 23 + k for k in range(20)}
    # Two days of 20 keys in a lot, and what the delay of a day still holds of the lot before.
    assert max(held) <= 80 and held[-1] <= 40


def test_stream_dedup_drops_late_copies(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:01:00")]
    frame = spark.createDataFrame(rows, "k long, s string").select("k", F.to_timestamp("s").alias("ts"))
    frame.coalesce(1).write.parquet(source)
    stream = ingest.dedup_stream(ingest.read_stream(spark, source, frame.schema), ["k"], "ts", "1 hour")
    seen = []
    ingest.run_available(stream, lambda batch, _: seen.extend(r["k"] for r in batch.collect()), str(tmp_path / "c"))
    assert sorted(seen) == [1, 2]


def test_a_batch_shuffles_neither_stored_rows_nor_words(spark, tmp_path, monkeypatch):
    """Keys are sent to the stored rows, texts are shuffled in place of their words, and
    replacing partitions shuffles nothing."""
    plans, whole = [], target.apply_batch

    def watched(batch, number, stream, path, keys, change, parts=None):
        def seen(rows, stored):
            fresh = change(rows, stored)
            plans.append(fresh._jdf.queryExecution().executedPlan().toString())
            return fresh
        return whole(batch, number, stream, path, keys, seen, parts)

    monkeypatch.setattr(ingest, "apply_batch", watched)
    index = ingest.refresh_postings(str(tmp_path / "index"), "k", "text", "s")
    for number in range(2):
        index(spark.createDataFrame([(k, number, f"red {number} red") for k in range(50 - number * 10)], SCHEMA), number)
    found = {(r["k"], r["token"], r["tf"]) for r in target.rows(spark, str(tmp_path / "index")).collect()}
    assert found == {(k, t, n) for k in range(50) for t, n in (("red", 2), ("1" if k < 40 else "0", 1))}
    assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]
    staged = []
    monkeypatch.setattr(target, "_replace", lambda rows, path, old=target._replace: (staged.append(rows), old(rows, path)))
    index(spark.createDataFrame([(1, 2, "blue")], SCHEMA), 2)
    assert "Rebalance" not in staged[0]._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
