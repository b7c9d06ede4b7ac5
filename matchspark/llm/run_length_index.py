"""Repeated byte strings through a run-length index.

The surroundings of repeated anchors are gathered into memory-sized collections. For each
collection the Burrows-Wheeler transform is built and only its runs are kept, with the
text place and the neighbour's match length sampled at every run's two ends. That is
enough to stream matching statistics over the texts: inside a run the match at a place is
the one at the place before it, less one byte, so all lengths follow from the samples.
Places that match 200 bytes elsewhere begin a removed window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.anchored import NEAR, SPAN, Anywhere, Shape, Spans, covered, identified, own_of, repeated_spans
from matchspark.llm.common import texts_of

SHAPE = Shape(words=False, window=200, gram=24, most=4096)
#: Bits of a place in a collection: three of them and a sort key fit 64 bits.
BITS = 21
FULL = 1 << BITS


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes. Every text ends with its own end mark, marks
    being smaller than bytes and ordered as their texts; left: bytes before the mark.

    Prefix doubling over the places still tied; a key is (rank, rank behind, place) packed
    into 64 bits. A suffix whose mark is within the compared part is tied with none.
    """
    n, bits = len(text), np.uint64(BITS)
    symbol = np.where(left > 0, text.astype(np.uint64) + np.uint64(1), np.uint64(0))
    padded = np.concatenate([symbol, np.zeros(4, np.uint64)])
    key = np.zeros(n, np.uint64)
    ended = np.zeros(n, bool)
    for i in range(4):
        ended |= left <= i if i == 0 else left < i
        key = (key << np.uint64(9)) | np.where(ended, np.uint64(0), padded[i:i + n])
    packed = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    at = (packed & np.uint64(FULL - 1)).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (packed[1:] >> bits) != (packed[:-1] >> bits)
    new |= left[at] < 4
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[at] = group
    alone = new & np.concatenate([new[1:], [True]])
    tied, depth = at[~alone], 4
    while len(tied):
        packed = np.sort((rank[tied].astype(np.uint64) << np.uint64(2 * BITS))
                         | (rank[tied + depth].astype(np.uint64) << bits) | tied.astype(np.uint64))
        depth *= 2
        at = (packed & np.uint64(FULL - 1)).astype(np.int64)
        pair, first = packed >> bits, packed >> np.uint64(2 * BITS)
        n_tied = np.arange(len(at))
        head = np.ones(len(at), bool)
        head[1:] = first[1:] != first[:-1]
        base = np.maximum.accumulate(np.where(head, n_tied, 0))
        new = head.copy()
        new[1:] |= pair[1:] != pair[:-1]
        new |= left[at] < depth
        group = np.maximum.accumulate(np.where(new, n_tied, 0))
        rank[at] = first.astype(np.int64) + (group - base)
        tied = at[~(new & np.concatenate([new[1:], [True]]))]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _common(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, before either's end mark."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    most = np.minimum(left[a], left[b])
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(open_):
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        differ = words[x] != words[y]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        out[open_] += same
        open_ = open_[(same == 8) & (out[open_] < most[open_])]
    return np.minimum(out, most)


class RunLengthIndex:
    """Runs of the transform of a collection, with samples at both ends of each run."""

    def __init__(self, bodies: list[bytes]):
        sizes = np.array([len(b) for b in bodies], np.int64)
        self.text = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8)
        self.ends = np.cumsum(sizes + 1)
        self.left = np.repeat(self.ends - 1, sizes + 1) - np.arange(len(self.text))
        order = suffix_order(self.text, self.left)
        before = order - 1
        at_start = (before < 0) | (self.left[before] == 0)
        symbol = np.where(at_start, -1, self.text[before].astype(np.int16))
        cut = np.ones(len(order) + 1, bool)
        cut[1:-1] = (symbol[1:] != symbol[:-1]) | at_start[1:] | at_start[:-1]
        heads, tails = np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:])
        self.symbols, self.lengths = symbol[heads], tails - heads + 1
        self.head_places, self.tail_places = order[heads], order[tails]
        up, down = heads > 0, tails < len(order) - 1
        self.head_match, self.tail_match = np.zeros(len(heads), np.int64), np.zeros(len(tails), np.int64)
        self.head_match[up] = _common(self.text, self.left, order[heads[up]], order[heads[up] - 1])
        self.tail_match[down] = _common(self.text, self.left, order[tails[down]], order[tails[down] + 1])

    def matches(self) -> np.ndarray:
        """For every place the length of the longest match that starts at another place."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for places, lengths in ((self.head_places, self.head_match), (self.tail_places, self.tail_match)):
            sampled = np.full(n, -1, np.int64)
            sampled[places] = np.arange(len(places))
            latest = np.maximum.accumulate(np.where(sampled >= 0, np.arange(n), -1))
            best = np.maximum(best, lengths[sampled[latest]] - (np.arange(n) - latest))
        return best


def _settle(bodies: list[tuple[bytes, list[tuple]]], window: int) -> Spans:
    index = RunLengthIndex([body for body, _ in bodies])
    long = index.matches() >= window
    starts = np.concatenate([[0], index.ends[:-1]])
    for (body, rows), at in zip(bodies, starts.tolist()):
        if len(rows) > 1:
            continue  # settled before, only there for others to match
        own, rid, lo, _, _ = rows[0]
        found = long[at:at + len(body) - window + 1]
        edge = np.diff(np.concatenate([[False], found, [False]]).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            yield own, rid, lo + a, lo + b - 1


def resolve(groups: Iterable) -> Spans:
    """Equal surroundings are repeats as they are; different ones of one gram meet in an index."""
    window, held, size = SHAPE.window, [], 0
    for _, kind, rows in groups:
        if kind == SPAN:
            for own, rid, lo, hi, _ in rows:
                yield own, rid, lo, hi
            continue
        by_body: dict[bytes, list[tuple]] = {}
        for row in rows:
            by_body.setdefault(row[4], []).append(row)
        for same in by_body.values():
            if len(same) > 1:
                for own, rid, lo, hi, _ in same:
                    yield own, rid, lo, hi
        if kind == NEAR and len(by_body) > 1:
            more = sum(len(b) + 1 for b in by_body)
            if held and size + more > FULL // 2:
                yield from _settle(held, window)
                held, size = [], 0
            held += by_body.items()
            size += more
    if held:
        yield from _settle(held, window)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).

    A byte goes if a string of 200 bytes that covers it starts at another place too, in
    any row, its own included. Null texts are empty; null keys and repeated rows are
    documents like others, so rows that repeat a long text lose it. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = identified(docs, key, text)
    spans = repeated_spans(rows, SHAPE, Anywhere, resolve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = texts_of(batch, "_text")
            kept, removed, runs = [], [], []
            for body, gone in zip(bodies, covered(batch, [len(b) for b in bodies])):
                if gone is None:
                    kept.append(body)
                    removed.append(0)
                    runs.append(0)
                    continue
                kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array([len(b) for b in bodies], pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.join(spans, "rid", "left").select(key, own_of(rows), "_text", "spans").mapInArrow(
        run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def removed_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
