"""Repeated windows: which windows of a corpus can occur twice, and where they meet.

A window (20 words, or 200 bytes) names one place in itself, its anchor: the leftmost of
its short grams with the smallest hash. Equal windows name equal grams, so a window can
only be repeated if its anchor's gram occurs at two anchors. About one place in eight (of
words) or in ninety (of bytes) is an anchor. Anchors are counted first; only those counted
twice are taken back to their texts, which then send what surrounds each of them, once,
to where all occurrences of the gram meet. Nothing is decided by hashes alone there.

Grams of very many anchors (passages that many documents share) are lengthened to whole
windows. Each task settles among these what it can by itself and sends on a few rows for
each different window, so that no group has more rows than a task can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import int_column, row_identity, texts_of, whole_text, worker_value

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once.
CHUNK = 1_500_000
#: Windows of lengthened grams that a task keeps before it sends on what it knows.
KEPT = 150_000
LEAST = -(1 << 63)


#: Bits of each of a spot's two distances; a window may be this much longer than a gram.
NARROW = 8


@dataclass(frozen=True)
class Shape:
    """What a window is. Grams at more than `most` anchors are lengthened to windows."""

    words: bool
    window: int
    gram: int
    most: int

    def __post_init__(self) -> None:
        if self.window - self.gram >= 1 << NARROW:
            raise ValueError(f"a window may have {(1 << NARROW) - 1} units more than its gram")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = worker_value("powers", dict)
    if held.get("n", -1) < n:
        held["n"] = max(n, CHUNK + 200_000)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(held["n"] + 1, base, np.uint64)
            p[0] = 1
            held[name] = np.cumprod(p)
    return held["up"], held["down"]


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)])])


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _leftmost_least(g: np.ndarray, m: int) -> np.ndarray:
    """For each run of m values the place of its smallest, the first of equals."""
    value, at, span = g, np.arange(len(g), dtype=np.int32), 1
    while span < m:
        step = min(span, m - span)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        at = np.where(right, at[step:], at[:-step])
        span += step
    return at


def spots_at(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One number for an anchor's place and the windows (starting at lo to hi) that name it;
    the lowest bit is left free."""
    return (place << (2 * NARROW + 1)) | ((place - lo) << (NARROW + 1)) | ((hi - lo) << 1)


def of_spot(spot: int) -> tuple[int, int, int, bool]:
    """(place, lo, hi, the lowest bit) of a spot."""
    place, narrow = spot >> (2 * NARROW + 1), (1 << NARROW) - 1
    lo = place - (spot >> (NARROW + 1) & narrow)
    return place, lo, lo + (spot >> 1 & narrow), bool(spot & 1)


def anchors_of(bodies: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, spot, hash) of each anchor."""
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    edges = np.cumsum([0, *map(len, bodies)])
    letters = LETTERS[flat]
    if shape.words:
        space = IS_SPACE[flat]
        before = np.concatenate([[True], space[:-1]]) if len(space) else space
        after = np.concatenate([space[1:], [True]]) if len(space) else space
        inner = edges[(edges > 0) & (edges < len(flat))]
        before[inner], after[inner - 1] = True, True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = _sums(letters)
        units = mix((sums[ends] - sums[starts]) * _powers(len(flat))[1][starts])
        edges = np.searchsorted(starts, edges)
    else:
        units = letters
    n = len(units)
    none = np.empty(0, np.int64)
    if n < shape.window:
        return none, none, none
    sums = _sums(units)
    grams = mix((sums[shape.gram:] - sums[:-shape.gram]) * _powers(n)[1][:n - shape.gram + 1])
    place = _leftmost_least(grams, shape.window - shape.gram + 1)
    last = np.repeat(edges[1:], np.diff(edges))[:len(place)]
    at = np.flatnonzero(np.arange(len(place)) + shape.window <= last)
    if not len(at):
        return none, none, none
    anchor = place[at]
    first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    lo, hi = at[first], at[np.concatenate([first[1:], [True]])]
    text = np.searchsorted(edges, lo, "right") - 1
    spot = spots_at(anchor[first].astype(np.int64) - edges[text], lo - edges[text], hi - edges[text])
    return text, spot, grams[anchor[first]].view(np.int64)


def _chunks(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, body in enumerate(bodies):
        if size and size + len(body) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(body)
    if start < len(bodies):
        yield start, len(bodies)


def find_anchors(rows: DataFrame, shape: Shape) -> DataFrame:
    """(h, rid, spot) of all anchors of rows (rid, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, rids = texts_of(batch, "_text"), int_column(batch, "rid")
            for a, b in _chunks(bodies):
                text, spot, h = anchors_of(bodies[a:b], shape)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(rids[a:b][text]), pa.array(spot)], names=["h", "rid", "spot"])

    return rows.select("rid", "_text").mapInArrow(run, "h long, rid long, spot long")


SENT = "mark long, kind int, own long, rid long, lo int, hi int, body binary"
SPAN, NEAR, WINDOW = 0, 1, 2


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


class _Sender:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["mark", "kind", "own", "rid", "lo", "hi", "body"]
        columns = list(zip(*self.rows)) or [[] for _ in kinds]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _window_row(digest: bytes, own: int, rid: int, at: int) -> tuple:
    return (int.from_bytes(digest[:8], "little", signed=True), WINDOW, own, rid, at, at, digest)


class Earliest:
    """Lengthened windows where every occurrence but the earliest goes.

    A window of a later document than one seen before is settled; else it may be the
    earliest. So is a whole surrounding that was seen in an earlier document.
    """

    once_a_text = True

    def __init__(self) -> None:
        self.first: dict[bytes, int] = {}
        self.bodies: dict[bytes, int] = {}

    def whole(self, body: bytes, own: int, rid: int, lo: int, hi: int) -> list[tuple] | None:
        """Rows that settle all windows of a surrounding; none if its windows must be seen one by one."""
        known = self.bodies.get(body)
        if known is not None and known < own:
            return [(rid, SPAN, own, rid, lo, hi, None)]
        self.bodies[body] = own
        return None

    def see(self, digest: bytes, own: int, rid: int, at: int) -> tuple[bool, list[tuple]]:
        """Whether this occurrence is settled, and rows about it or an earlier one."""
        known = self.first.get(digest)
        if known is not None and known < own:
            return True, []
        self.first[digest] = own
        return False, [_window_row(digest, own, rid, at)]

    def flush(self) -> list[tuple]:
        self.first, self.bodies = {}, {}
        return []


class Anywhere:
    """Lengthened windows where every occurrence goes if there are two.

    Of a window or whole surrounding seen twice each occurrence is settled; one row of each
    window is sent on.
    """

    once_a_text = False

    def __init__(self) -> None:
        self.first: dict[bytes, tuple[int, int, int]] = {}
        self.twice: set[bytes] = set()
        self.bodies: dict[bytes, tuple | None] = {}

    def whole(self, body: bytes, own: int, rid: int, lo: int, hi: int) -> list[tuple] | None:
        span = (rid, SPAN, own, rid, lo, hi, None)
        if body not in self.bodies:
            self.bodies[body] = span
            return None
        first, self.bodies[body] = self.bodies[body], None
        return [span] if first is None else [first, span]

    def see(self, digest: bytes, own: int, rid: int, at: int) -> tuple[bool, list[tuple]]:
        known = self.first.get(digest)
        if known is None:
            self.first[digest] = (own, rid, at)
            return False, []
        if digest in self.twice:
            return True, []
        self.twice.add(digest)
        return True, [(known[1], SPAN, known[0], known[1], known[2], known[2], None)]

    def flush(self) -> list[tuple]:
        rows = [_window_row(digest, own, rid, at) for digest, (own, rid, at) in self.first.items()]
        self.first, self.twice, self.bodies = {}, set(), {}
        return rows


def runs_of(places: Iterable[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive places; places ascend."""
    start = last = None
    for at in places:
        if last is None or at > last + 1:
            if last is not None:
                yield start, last
            start = at
        last = at
    if last is not None:
        yield start, last


def send_surroundings(rows: DataFrame, spots: DataFrame, shape: Shape, settle: type) -> DataFrame:
    """What surrounds each repeated anchor, sent under its gram's hash; see SENT.

    NEAR: body holds all windows of the anchor. WINDOW: one window's digest (128 bit).
    SPAN: windows lo to hi are already known to be repeated. Grams are hashed here again, so
    that spots need not carry hashes. Earlier documents of a batch go first: what repeats
    them is then settled in the task.
    """
    window, gram = shape.window, shape.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, local = _Sender(), settle()
        for batch in batches:
            spots = batch["spots"]
            offsets, flat = spots.offsets.to_numpy(), spots.values
            flat = flat.to_numpy(zero_copy_only=False)
            rids, owns = int_column(batch, "rid").tolist(), int_column(batch, "own")
            bodies = texts_of(batch, "_text")
            for i in np.argsort(owns, kind="stable").tolist():
                own, rid, body = int(owns[i]), rids[i], bodies[i]
                units = body.split() if shape.words else body
                mine: set[bytes] = set()
                settled: list[int] = []
                for place, lo, hi, many in map(of_spot, sorted(flat[offsets[i]:offsets[i + 1]].tolist())):
                    if hi + window > len(units):
                        continue  # another text's place, under an equal 64-bit identity
                    part = units[lo:hi + window]
                    part = b" ".join(part) if shape.words else part
                    known = local.whole(_digest(part), own, rid, lo, hi)
                    if known is not None:  # settled by what this task has seen; the text need not travel
                        out.rows += known
                        continue
                    if not many:
                        near = units[place:place + gram]
                        near = xxhash.xxh3_64_intdigest(b" ".join(near) if shape.words else near)
                        out.rows.append((near - (1 << 63), NEAR, own, rid, lo, hi, part))
                        continue
                    for at in range(lo, hi + 1):
                        part = units[at:at + window]
                        digest = _digest(b" ".join(part) if shape.words else part)
                        if local.once_a_text and digest in mine:
                            settled.append(at)
                            continue
                        mine.add(digest)
                        done, rows = local.see(digest, own, rid, at)
                        out.rows += rows
                        if done:
                            settled.append(at)
                out.rows += [(rid, SPAN, own, rid, a, b, None) for a, b in runs_of(settled)]
                if len(out.rows) > 8000:
                    yield out.batch()
                if len(local.first) + len(local.bodies) > KEPT:
                    out.rows += local.flush()
        out.rows += local.flush()
        yield out.batch()

    return rows.join(spots, "rid").select(own_of(rows), "rid", "_text", "spots").mapInArrow(run, SENT)


def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(mark, kind, rows of own, rid, lo, hi, body) of sorted batches, group by group."""
    mark, kind, rows = None, None, []
    for batch in batches:
        marks, kinds = int_column(batch, "mark"), int_column(batch, "kind")
        body = list(zip(*(batch[c].to_pylist() for c in ("own", "rid", "lo", "hi", "body"))))
        cuts = np.flatnonzero((marks[1:] != marks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        edges = [0, *cuts.tolist(), len(marks)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            key = (int(marks[a]), int(kinds[a]))
            if key == (mark, kind):
                rows += body[a:b]
            else:
                if rows:
                    yield mark, kind, rows
                (mark, kind), rows = key, body[a:b]
    if rows:
        yield mark, kind, rows


Spans = Iterator[tuple[int, int, int, int]]


def repeated_spans(rows: DataFrame, shape: Shape, settle: type, resolve: Callable[[Iterable], Spans]) -> DataFrame:
    """(rid, spans array<struct<own, a, b>>): units a up to b are in repeated windows.

    rows are those of identified. resolve turns the groups
    of a task, read one by one, into (own, rid, first window, last window).
    """
    # Anchors are found twice: once more over the texts costs less than keeping them on disk.
    anchors = find_anchors(rows, shape)
    twice = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    marked = F.col("spot") + (F.col("n") > shape.most).cast("long")
    spots = anchors.join(twice, "h").groupBy("rid").agg(F.collect_set(marked).alias("spots"))
    sent = send_surroundings(rows, spots, shape, settle)
    window = shape.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [np.array(c, np.int64) for c in zip(*held)] or [np.empty(0, np.int64)] * 4
            held.clear()
            own, rid, lo, hi = columns
            return pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(own), pa.array(lo.astype(np.int32)), pa.array((hi + window).astype(np.int32))],
                names=["rid", "own", "a", "b"])

        for span in resolve(groups_of(batches)):
            held.append(span)
            if len(held) >= 20_000:
                yield batch()
        yield batch()

    met = sent.repartition("mark").sortWithinPartitions("mark", "kind")
    spans = met.mapInArrow(run, "rid long, own long, a int, b int")
    return spans.groupBy("rid").agg(F.collect_set(F.struct("own", "a", "b")).alias("spans"))


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rid, _text): rid tells rows apart. Both joins to the texts take these columns,
    so that Spark shuffles the texts once and reads them twice."""
    return docs.select(F.col(key), row_identity(key, text).alias("rid"), whole_text(text).alias("_text"))


def own_of(rows: DataFrame) -> Column:
    """The document's place in order, made after the join; null keys come first."""
    return F.coalesce(F.col(rows.columns[0]).cast("long"), F.lit(LEAST)).alias("own")


def covered(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[np.ndarray | None]:
    """For each row which of its units are in a span; none: no unit is."""
    spans, owns = batch["spans"].fill_null([]), int_column(batch, "own")
    offsets, flat = spans.offsets.to_numpy(), spans.values
    own, a, b = (flat.field(k).to_numpy() for k in ("own", "a", "b"))
    for i, n in enumerate(sizes):
        part = slice(offsets[i], offsets[i + 1])
        mine = own[part] == owns[i]
        if not mine.any():
            yield None
            continue
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, np.minimum(a[part][mine], n), 1)
        np.add.at(change, np.minimum(b[part][mine], n), -1)
        yield np.cumsum(change[:-1]) > 0
