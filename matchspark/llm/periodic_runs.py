"""Runs of repeated words by enumerating maximal pairs.

Documents are handled some at a time. Ranks of word sequences are doubled in length until
all differ, following only those that still repeat inside their document; sorted by rank,
the suffixes and their common prefixes are the leaves of the tree of LCP intervals. The tree
is walked bottom-up: every interval has the list of its positions, with the class of each by
the word on its left, made from its children's by adding the smaller lists to the largest.

Two neighbours in the list of an interval of depth L that came from different children and
classes are a maximal pair: L words agree, and neither the word before nor the one behind.
Where their distance q is at most L / (exponent - 1), it is the smallest period of those
L + q words: a smaller one would divide q and put another position of the list between the
two. So these pairs are exactly the runs, each once, and nothing is extended or compared.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import texts_of, whole_text

#: A run has at least so many words, and so many periods.
LEAST, EXPONENT = 6, 4
#: Words handled together; a longer document alone.
WORDS = 200_000


def _suffixes(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next `depth` words (or a power of two of fewer) repeat, in suffix
    order, and the common prefix of each with the next."""
    n = len(codes)
    counts = np.bincount(codes)
    rank = (np.cumsum(counts) - counts)[codes]
    active = np.flatnonzero(counts[codes] > 1)
    levels, wide, repeated = [], 1, active
    while len(active):
        levels.append((wide, rank.astype(np.int32 if n < 2**31 else np.int64)))
        if wide <= depth:
            repeated = active
        old = rank[active]
        both = old * n + rank[active + wide]
        order = np.argsort(both)
        both, old, active = both[order], old[order], active[order]
        at = np.arange(len(active))
        first = np.r_[True, both[1:] != both[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        part = np.maximum.accumulate(np.where(first, at, 0))
        rank[active] = old + part - group
        sizes = np.diff(np.r_[np.flatnonzero(first), len(active)])
        active = active[np.repeat(sizes > 1, sizes)]
        wide *= 2
    order = repeated[np.argsort(rank[repeated])]
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(len(order) - 1, 0), np.int64)
    for wide, level in reversed(levels):
        more = wide * (level[a] == level[b])
        common, a, b = common + more, a + more, b + more
    return order, common


def _pairs(order: list[int], common: list[int], left: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """(first, second, depth) of the neighbouring maximal pairs in one tree of intervals."""
    found: list[tuple[int, int, int]] = []
    child_of: dict[int, int] = {}
    serial = 0

    def merged(depth: int, children: list[list[int]]) -> list[int]:
        nonlocal serial
        before = serial
        children.sort(key=len)
        whole = children.pop()
        added = []
        for child in children:
            serial += 1
            child_of.update(dict.fromkeys(child, serial))
            added += child
        if 8 * len(added) > len(whole):
            whole += added
            whole.sort()
        else:
            for p in added:
                whole.insert(bisect_left(whole, p), p)
        limit = depth // reach
        if limit:
            for p in added:
                i = bisect_left(whole, p)
                a, b = whole[i - 1] if i else p, whole[i + 1] if i + 1 < len(whole) else p
                if 0 < p - a <= limit and left[a] != left[p] and child_of.get(a) != child_of[p]:
                    found.append((a, p, depth))
                # A next position that was added too has met this one as its previous.
                if 0 < b - p <= limit and left[b] != left[p] and child_of.get(b, 0) <= before:
                    found.append((p, b, depth))
        return whole

    open_nodes: list[tuple[int, list[list[int]]]] = []
    last = [order[0]]
    # The common prefix of -1 behind the last position closes whatever is open.
    for p, depth in zip([*order[1:], -1], [*common, -1]):
        while open_nodes and open_nodes[-1][0] > depth:
            level, children = open_nodes.pop()
            last = merged(level, [*children, last])
        if open_nodes and open_nodes[-1][0] == depth:
            open_nodes[-1][1].append(last)
        else:
            open_nodes.append((depth, [last]))
        last = [p]
    return found


def runs_in(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of dense numbers, in no order.

    The last number must be found nowhere else; documents in a row end with such a number
    each and share no others.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods can't be told from pairs of neighbours")
    reach = exponent - 1
    depth = min(max(least - q, reach * q) for q in range(1, least + 1))
    order, common = _suffixes(codes, depth)
    if len(order) < 2:
        return []
    first = np.flatnonzero(np.r_[True, common < depth])
    sizes = np.diff(np.r_[first, len(order)])
    tree = np.repeat(np.arange(len(first)), sizes)
    # A tree can only hold a run if two of its positions are near enough for its deepest interval.
    by_place = np.lexsort((order, tree))
    gaps = np.diff(order[by_place])
    gaps[np.diff(tree) > 0] = len(codes)
    nearest = np.minimum.reduceat(np.r_[gaps, len(codes)], first)
    inside = np.r_[common, 0]
    inside[first[1:] - 1] = 0
    deepest = np.maximum.reduceat(inside, first)
    left = np.r_[-1, codes[:-1]]
    found = []
    for k in np.flatnonzero((sizes > 1) & (nearest * reach <= deepest)):
        lo, hi = first[k], first[k] + sizes[k]
        for a, b, level in _pairs(order[lo:hi].tolist(), common[lo:hi - 1].tolist(), left, reach):
            if level + b - a >= least:
                found.append((a, level + b - a, b - a))
    return found


def repeated_tail(n: int, number: int) -> np.ndarray:
    """For each of n words the place of the word put there, so that those from number % n on
    repeat with the period 1 + floor((n - number % n) / (3 + number % 8))."""
    a = number % n
    period = 1 + (n - a) // (3 + number % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % period)


def _handled(bodies: list[tuple[list[bytes], np.ndarray | None]], least: int, exponent: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs and collapsed text of each document: its words, and the places they are put in."""
    parts, starts, base = [], [], 0
    total = 0
    for words, place in bodies:
        seen: dict[bytes, int] = {}
        code = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64) + base
        parts.append(code if place is None else code[place])
        base += len(seen)
        parts.append(np.array([base]))
        base += 1
        starts.append(total)
        total += len(words) + 1
    codes = np.concatenate(parts)
    if bodies and any(place is not None for _, place in bodies):
        codes = np.unique(codes, return_inverse=True)[1]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in bodies]
    for start, length, period in runs_in(codes, least, exponent):
        k = int(np.searchsorted(starts, start, side="right")) - 1
        runs[k].append((int(start - starts[k]), int(length), int(period)))
    texts = []
    for (words, place), found in zip(bodies, runs):
        found.sort(key=lambda r: (r[0], r[2]))
        if place is not None:
            words = [words[i] for i in place]
        if found:
            cover = np.zeros(len(words) + 1, np.int64)
            for start, length, period in found:
                cover[start + period] += 1
                cover[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
        texts.append(b" ".join(words))
    return runs, texts


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT, tail: Column | None = None) -> DataFrame:
    """key, runs (array of start, length, period by start and period), collapsed: one row per
    row of docs, repeated rows too.

    Words are what ASCII white space separates, numbered from 0. A run is a stretch of words
    with smallest period q, of at least `least` words and `exponent` periods, that no
    neighbouring word extends. collapsed is the text without the words that any run contains
    behind its first q words, joined by one space. `tail`, where it is given and not null,
    is a number by which the end of the text is made to repeat first (repeated_tail).
    A null text is empty and has no runs; only the named columns are read; the key may be of
    any type, null or repeated. Whole texts are handled: memory grows with the longest one.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"), (F.lit(None).cast("long") if tail is None else tail.cast("long")).alias("tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[list[bytes], np.ndarray | None]] = []
            words, done = 0, 0
            numbers = batch["tail"].to_pylist()
            for i, body in enumerate(texts_of(batch, "text")):
                parts = body.split()
                held.append((parts, repeated_tail(len(parts), numbers[i]) if parts and numbers[i] is not None else None))
                words += len(parts) + 1
                if words < WORDS and i + 1 < batch.num_rows:
                    continue
                runs, texts = _handled(held, least, exponent)
                sizes = np.cumsum([0, *map(len, runs)], dtype=np.int32)
                flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].slice(done, len(held)), pa.ListArray.from_arrays(pa.array(sizes), fields), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["key", "runs", "collapsed"])
                done, held, words = i + 1, [], 0

    out = rows.mapInArrow(run, f"key {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.select(F.col("key").alias(key), "runs", "collapsed")


def digests(docs: DataFrame) -> DataFrame:
    """The run of greatest length and digests of all, of documents of which one in ten (by
    its key's crc32) has a tail made to repeat; a null key changes no text."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = find_runs(docs, tail=F.when(number % 10 == 0, F.floor(number / 10)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
