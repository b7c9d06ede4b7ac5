"""Near copies by SimHash fingerprints and pigeonring filtering.

64 bits are a ring of five segments. Where two fingerprints differ in at most four bits,
some chain of consecutive segments starts with no difference and stays within its share
of the four: at most 1 in two segments, 2 in three, 3 in four. The first two segments of
such a chain are the key under which fingerprints meet (one bit of the second may differ,
so the fingerprint with a 0 there is also sent under the key with a 1); the longer
prefixes of the chain prune what meets, and the whole distance decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import int_column, one_of_each, staged, texts_of, whole_text
from matchspark.llm.components import components

LIMIT = 4
#: First bit and width of each segment.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
SHINGLE = 4
#: Fingerprints under one key that a task compares by itself; more are dealt out in tiles of half of this.
GROUP = 8192
#: Groups of up to this many are compared pair by pair, all groups of a batch together.
FEW = 16
NONE = -1


def budget(segments: int) -> int:
    """Differences allowed in a chain of so many segments."""
    return segments * LIMIT // len(SEGMENTS)


def _mask(first: int, segments: int) -> np.uint64:
    out = 0
    for i in range(first, first + segments):
        at, width = SEGMENTS[i % len(SEGMENTS)]
        out |= ((1 << width) - 1) << at
    return np.uint64(out)


def _linked(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether differences x pass every prefix of the chain from segment first, then the whole check."""
    alive = np.arange(len(x))
    for n in range(1, len(SEGMENTS) + 1):
        masks = np.array([_mask(i, n) for i in range(len(SEGMENTS))], np.uint64)[first[alive]]
        alive = alive[np.bitwise_count(x[alive] & masks) <= budget(n)]
        if not len(alive):
            break
    out = np.zeros(len(x), bool)
    out[alive] = np.bitwise_count(x[alive]) <= LIMIT
    return out


def fingerprint(body: bytes) -> int:
    """SimHash of a lower-cased text's 4-word shingles; no words give zero."""
    import xxhash

    words = body.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:len(words) - SHINGLE].tolist()]
    ends = (ends[SHINGLE - 1:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for a in range(0, len(starts), 8192):
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts[a:a + 8192], ends[a:a + 8192])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str, text: str, digest: bool = False) -> DataFrame:
    """(key, fp long), with digest also _digest, the text's SHA-256."""
    rows = docs.select(F.col(key), whole_text(text).alias("_text"))
    if digest:
        rows = rows.withColumn("_digest", F.sha2("_text", 256))
    others = [c for c in rows.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in texts_of(batch, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(prints, pa.int64())], names=[*others, "fp"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{kinds}, fp long")


def ring_keys(prints: DataFrame) -> DataFrame:
    """(mark, fp): each distinct fingerprint under the keys of all chains it may begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                fp = int_column(batch, "fp").view(np.uint64)
                marks, owners = [], []
                for i, (at, width) in enumerate(SEGMENTS):
                    second, second_width = SEGMENTS[(i + 1) % len(SEGMENTS)]
                    one = (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)
                    two = (fp >> np.uint64(second)) & np.uint64((1 << second_width) - 1)
                    base = np.uint64(i << 32) | (one << np.uint64(13))
                    marks.append(base | two)
                    owners.append(fp)
                    for b in range(second_width):
                        zero = (two >> np.uint64(b)) & np.uint64(1) == 0
                        marks.append((base | two | np.uint64(1 << b))[zero])
                        owners.append(fp[zero])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(marks).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64))],
                    names=["mark", "fp"])

    return prints.mapInArrow(run, "mark long, fp long")


def spanning_links(fps: np.ndarray, first: int) -> tuple[list[int], list[int]]:
    """Links that connect what is linked within a group, one for each fingerprint at most.

    Each fingerprint is compared only with those that no link has reached yet, so a dense
    group costs little more than its size.
    """
    rest, a, b = np.unique(fps), [], []
    while len(rest) > 1:
        stack, rest = [rest[-1]], rest[:-1]
        while stack and len(rest):
            at = stack.pop()
            near = _linked(rest ^ at, np.full(len(rest), first))
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a += [int(at)] * len(found)
                b += found.tolist()
                stack += list(found)
    return a, b


def _out(mark: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    columns = [np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (mark, a, b)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mark", "a", "b"])


def _links_of(marks: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links within complete groups, sorted by mark."""
    segment = (marks >> 32).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(marks[1:] != marks[:-1]) + 1, [len(marks)]])
    sizes = np.repeat(np.diff(edges), np.diff(edges))
    a, b = [], []
    for step in range(1, FEW):
        at = np.flatnonzero((marks[step:] == marks[:-step]) & (sizes[step:] <= FEW)) if len(marks) > step else []
        if not len(at):
            break
        linked = at[_linked(fps[at] ^ fps[at + step], segment[at])]
        a.append(fps[linked].view(np.int64))
        b.append(fps[linked + step].view(np.int64))
    for start, end in zip(edges[:-1], edges[1:]):
        if end - start > FEW:
            x, y = spanning_links(fps[start:end], int(segment[start]))
            a.append(np.array(x, np.uint64).view(np.int64))
            b.append(np.array(y, np.uint64).view(np.int64))
    n = sum(map(len, a))
    yield _out([np.full(n, NONE)], a, b)


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (mark, fp); rows of a key with too many fingerprints pass on for tiling."""
    marks, fps, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        marks = np.concatenate([marks, int_column(batch, "mark")])
        fps = np.concatenate([fps, int_column(batch, "fp").view(np.uint64)])
        if hot is not None:
            n = int(np.searchsorted(marks, hot, "right"))
            yield _out([marks[:n]], [fps[:n].view(np.int64)], [np.zeros(n, np.int64)])
            marks, fps = marks[n:], fps[n:]
        if not len(marks):
            continue
        last = int(np.searchsorted(marks, marks[-1], "left"))
        if last:
            yield from _links_of(marks[:last], fps[:last])
            marks, fps = marks[last:], fps[last:]
        hot = int(marks[0]) if len(marks) > GROUP else None
        if hot is not None:
            yield _out([marks], [fps.view(np.int64)], [np.zeros(len(marks), np.int64)])
            marks, fps = marks[:0], fps[:0]
    if len(marks):
        yield from _links_of(marks, fps)


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within LIMIT bits of each other."""
    keyed = ring_keys(prints.select("fp").distinct()).repartition("mark").sortWithinPartitions("mark")
    met = staged(keyed.mapInArrow(_meet, "mark long, a long, b long"), "links")
    hot = met.where(F.col("mark") != NONE).select("mark", F.col("a").alias("fp"))
    tiles = hot.groupBy("mark").agg(F.ceil(F.count(F.lit(1)) * 2 / group).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # Every pair of tiles meets in one group, a tile with itself among them.
    dealt = hot.join(tiles, "mark").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("mark", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([int_column(batch, c).astype(np.int64) for c in ("mark", "x", "y")], axis=1)
            fps = int_column(batch, "fp").view(np.uint64)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(edges[:-1], edges[1:]):
                if start == end:
                    continue
                now = tuple(keys[start])
                if now != key:
                    if held:
                        a, b = spanning_links(np.concatenate(held), int(key[0]) >> 32)
                        yield _out([np.full(len(a), NONE)], [np.array(a, np.uint64).view(np.int64)], [np.array(b, np.uint64).view(np.int64)])
                    key, held = now, []
                held.append(fps[start:end])
        if held:
            a, b = spanning_links(np.concatenate(held), int(key[0]) >> 32)
            yield _out([np.full(len(a), NONE)], [np.array(a, np.uint64).view(np.int64)], [np.array(b, np.uint64).view(np.int64)])

    more = dealt.repartition("mark", "x", "y").sortWithinPartitions("mark", "x", "y").mapInArrow(tiled, "mark long, a long, b long")
    return met.where(F.col("mark") == NONE).select("a", "b").unionByName(more.select("a", "b"))


def _rooted(prints: DataFrame, least: DataFrame, group: int) -> DataFrame:
    """fp, _least, root: the rows of least (fp, _least), each with the root of its component."""
    found = components(links(prints, group))
    return least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per row of docs: key, fp (long), component_id.

    Texts are near when their fingerprints differ in at most four bits; component_id is the
    smallest key that chains of near texts reach. Null, empty and blank texts have
    fingerprint zero, which is linked like any other. Null keys are passed over when the
    smallest is taken (null if there is no other). Repeated rows are documents like others;
    other columns are not read. An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, key, text), "prints")
    rooted = _rooted(prints, prints.groupBy("fp").agg(F.min(key).alias("_least")), group)
    ids = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def near_digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """docs with one row of each group of near texts: one with the smallest key.

    Of rows that repeat the smallest key within the group one stays (that of the least
    text digest), and of a group of null keys only one row too. A row whose key stays for
    a text of another group is judged in its own group only.
    """
    prints = staged(fingerprints(docs, key, text, digest=True), "prints")
    first = F.struct(F.col(key).isNull(), F.col(key).alias("_kept_key"), F.col("_digest"))
    rooted = _rooted(prints, prints.groupBy("fp").agg(F.min(first).alias("_least")), group)
    keep = rooted.groupBy("root").agg(F.min("_least").alias("_least")).select("_least._kept_key", "_least._digest")
    return one_of_each(docs, key, whole_text(text), keep)
