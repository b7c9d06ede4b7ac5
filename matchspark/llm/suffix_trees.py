"""Repeated word passages by prefix-partitioned suffix trees.

The suffixes that can begin a repeated window are split by prefixes of variable length: a
prefix of a few words, and where too many suffixes share it, of a whole window. What
shares a prefix fits into memory: its suffixes are sorted and, with the words that
neighbours have in common, form a subtree. Its internal nodes at least as deep as a window
are repeated passages, the leaves below them their places; all but the earliest are removed.
A prefix as long as a window is such a node itself, and its places need no order below it.
A subtree's suffixes end with their surroundings, so passages longer than a window come
from the nodes of several prefixes, and their places are joined document by document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.anchored import NEAR, SPAN, Earliest, Shape, Spans, covered, identified, own_of, repeated_spans, runs_of
from matchspark.llm.common import texts_of

#: Twenty words a window, prefixes of six words, at most so many suffixes' surroundings a subtree.
SHAPE = Shape(words=True, window=20, gram=6, most=4096)


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Words that two suffixes have in common before they differ or one ends."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def deep_nodes(depths: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last leaf) of the internal nodes of at least that depth that have none
    such above them. depths: words in common of each sorted suffix and the next.

    Bottom-up over the depths: a node is open as long as no shallower depth follows, and a
    closing one hands its first leaf to its parent.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*depths, -1]):
        first = i
        while stack and stack[-1][0] >= depth:
            inner, first = stack.pop()
            if inner >= least and (stack[-1][0] if stack else -1) < least and depth < least:
                yield inner, first, i
        stack.append((depth, first))


def subtree(bodies: dict[bytes, list[tuple[int, int, int]]], window: int) -> Spans:
    """Removed windows among different surroundings of one prefix; each has the places of its earliest occurrence.

    The suffixes of the surroundings that hold a window are sorted; with the words that
    neighbours have in common they are the prefix's subtree. Leaves below one node at least
    as deep as a window are the places of one repeated passage: all but the earliest go.
    """
    suffixes = []
    for body, places in bodies.items():
        words = body.split(b" ")
        for j in range(len(words) - window + 1):
            suffixes.append((words[j:], j, places))
    suffixes.sort(key=lambda s: s[0])
    depths = [common_words(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
    gone: dict[tuple[int, int], set[int]] = {}
    for _, first, last in deep_nodes(depths, window):
        leaves = sorted((own, lo + j, rid) for _, j, places in suffixes[first:last + 1] for own, rid, lo in places)
        earliest, rows = leaves[0][0], set()
        for own, at, rid in leaves:
            if own > earliest or rid in rows:
                gone.setdefault((own, rid), set()).add(at)
            else:
                rows.add(rid)
    for (own, rid), at in gone.items():
        for a, b in runs_of(sorted(at)):
            yield own, rid, a, b


def resolve(groups: Iterable) -> Spans:
    window = SHAPE.window
    for _, kind, rows in groups:
        if kind == SPAN:
            for own, rid, lo, hi, _ in rows:
                yield own, rid, lo, hi
            continue
        by_body: dict[bytes, list[tuple]] = {}
        for row in rows:
            by_body.setdefault(row[4], []).append(row)
        kept: dict[bytes, list[tuple[int, int, int]]] = {}
        for body, same in by_body.items():
            if len(same) == 1:
                own, rid, lo, _, _ = same[0]
                kept[body] = [(own, rid, lo)]
                continue
            # Equal surroundings: only the earliest stays (of repeated rows each, as none is earlier).
            earliest = min(row[0] for row in same)
            first: dict[int, int] = {}
            for own, rid, lo, _, _ in same:
                if own == earliest:
                    first[rid] = min(lo, first.get(rid, lo))
            for own, rid, lo, hi, _ in same:
                if own > earliest or lo > first[rid]:
                    yield own, rid, lo, hi
            kept[body] = [(earliest, rid, lo) for rid, lo in first.items()]
        if kind == NEAR and len(kept) > 1:
            yield from subtree(kept, window)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of 20 words that covers it has the same words as one that
    starts earlier: in a document with a smaller key, or earlier in its own. Null and
    empty texts have no words; null keys come before all others. Rows that repeat a key
    are not earlier than each other. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = identified(docs, key, text)
    spans = repeated_spans(rows, SHAPE, Earliest, resolve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [t.split() for t in texts_of(batch, "_text")]
            kept, removed = [], []
            for words, gone in zip(split, covered(batch, [len(w) for w in split])):
                if gone is not None:
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(b" ".join(words))
                removed.append(int(gone.sum()) if gone is not None else 0)
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array([len(w) for w in split], pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "n_removed", "kept"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.join(spans, "rid", "left").select(key, own_of(rows), "_text", "spans").mapInArrow(
        run, f"`{key}` {kind}, n_words long, n_removed long, kept string")


def removed_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
