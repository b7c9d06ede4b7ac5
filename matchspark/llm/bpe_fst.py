"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly when each neighbouring
pair is the encoding of its own bytes, so every prefix of a piece has one last token. The
transducer reads bytes; its state is the last token it has emitted and the bytes behind
it. A step finds the last token of the longer prefix, takes the places from which some
token could still grow over the end, and emits the tokens that the paths back from all
these places share: what it emits no later byte can change, and it holds back only bytes
within reach of one unfinished token. States and steps are made when first met.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import slices, texts_of, whole_text, with_columns, worker_value

#: Entries a worker keeps of each kind, so that texts of unlimited variety stay within memory.
UNITS, PIECES, STATES, STEPS = 150_000, 100_000, 250_000, 500_000
NEVER = 1 << 60


class Transducer:
    """Encoder of single pieces for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.open = {token[:n] for token in ranks for n in range(1, len(token))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: By token, for its right (1) and left (0) edge; no more than there are tokens.
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        #: A state: last token emitted (-1: none), pending bytes, for each pending end the token that ends
        #: there, and the places from which some token can still grow.
        self.states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = [(-1, b"", (), (0,))]
        self.ids = {(-1, b"", ()): 0}
        #: The steps of each state: next state and emitted tokens by byte.
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.made = 0
        #: Equal outputs and places are kept once.
        self.outputs: dict[tuple[int, ...], tuple[int, ...]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte."""
        if token not in self.halves:
            body, own = self.tokens[token], token
            parts = [body[i:i + 1] for i in range(len(body))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank >= own:
                    raise ValueError(f"token {token} can't be made by merges")
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]])
        return self.halves[token]

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one edge of a token while it is being merged, first to last, and NEVER."""
        out = self.spines[side].get(token)
        if out is None:
            parts = self.split(token)
            out = [token, NEVER] if parts is None else [*self.spine(parts[side], side)[:-1], token, NEVER]
            self.spines[side][token] = out
        return out

    def stays(self, left: int, right: int) -> bool:
        """Whether merging left and right together would leave the border between them."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            a, b = self.spine(left, 1), self.spine(right, 0)
            i = j = 0
            known = True
            while True:
                # What happens first: the edge tokens' own next merges, or one across the border.
                next_a, next_b = a[i + 1], b[j + 1]
                across = self.ranks.get(self.tokens[a[i]] + self.tokens[b[j]], NEVER)
                if across < next_a and across <= next_b and across < NEVER:
                    known = False
                    break
                if next_a == next_b == NEVER:
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= STATES:
                self.pairs.clear()
            self.pairs[left << 32 | right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        start, pending, ends, live = self.states[state]
        pending += bytes((byte,))
        n = len(pending)
        ranks, unfinished = self.ranks, self.open
        last, growing = -1, []
        for at in live:  # the token that ends here began where a token could still grow
            tail = pending[at:]
            if last < 0 and (token := ranks.get(tail)) is not None:
                before = ends[at - 1] if at else start
                if before < 0 or self.stays(before, token):
                    last = token
            if tail in unfinished:
                growing.append(at)
        if last < 0:
            raise ValueError("bytes without a token")
        ends += (last,)
        live = (*growing, n)
        # The nearest place that the paths back from all live places share.
        settled = n
        if growing:
            sizes, met = self.sizes, set(live)
            while len(met) > 1:
                far = max(met)
                met.remove(far)
                met.add(far - sizes[ends[far - 1]])
            settled = met.pop()
        out = self._tokens(settled, ends)
        if out:
            start, pending, ends = out[-1], pending[settled:], ends[settled:]
            live = tuple([at - settled for at in live])
        # Equal futures, one state: what no live place leads back to is forgotten, and so is the
        # token before, unless one may still start right behind it.
        sizes, marked = self.sizes, [-1] * len(ends)
        for at in live:
            while at > 0 and marked[at - 1] < 0:
                token = marked[at - 1] = ends[at - 1]
                at -= sizes[token]
        key = (start if live[0] == 0 else -1, pending, tuple(marked))
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append((*key, self.outputs.setdefault(live, live)))
        self.made += 1
        return found, self.outputs.setdefault(tuple(out), tuple(out))

    def _tokens(self, at: int, ends: tuple[int, ...]) -> list[int]:
        """The tokens between the last emitted one and a place."""
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= self.sizes[ends[at - 1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) >= STATES or self.made >= STEPS:
            self.clear()
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = steps[state << 8 | byte] = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        ends = self.states[state][2]
        return out + self._tokens(len(ends), ends)


class Encoder:
    """Whole texts to token ids (little-endian 32 bit), with the words met before kept.

    A piece always starts at a space that something other than white space follows, so a
    text may be cut there and its cuts encoded one by one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.ranks = Transducer(ranks), ranks
        self.pattern = regex.compile(pattern)
        self.cuts = regex.compile(r" (?=\S)")
        self.doubtful = regex.compile(r" (?!\S)")
        #: Newer and older entries: what is met again moves to the newer ones, the rest goes.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.older_pieces.get(piece)
        if ids is None:
            body = piece.encode()
            token = self.ranks.get(body)
            ids = array("I", self.transducer.encode(body) if token is None else (token,)).tobytes()
        if len(piece) < 64:
            if len(self.pieces) >= PIECES:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def _unit(self, unit: str) -> bytes:
        pieces = self.pattern.findall(unit)
        return b"".join([self.pieces.get(p) or self._piece(p) for p in pieces])

    def _learn(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._unit(" " + word)
        if len(word) < 64:
            if len(self.known) >= UNITS:  # the words met since the last time stay
                self.older, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def _doubtful(self, text: str) -> bytes:
        words = self.cuts.split(text)
        return b"".join([self._unit(words[0]), *[self.known.get(w) or self._learn(w) for w in words[1:]]])

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; a word that the texts share is looked up once.

        Cycles are not looked for meanwhile: none are made, and the collector would walk
        through all states again and again.
        """
        watched = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if watched:
                gc.enable()

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        odd = {i: self._doubtful(t) for i, t in enumerate(texts) if self.doubtful.search(t) is not None}
        split = pc.split_pattern(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string()), " ")
        table = split.flatten().dictionary_encode()
        coded = [self.known.get(w) or self._learn(w) for w in table.dictionary.to_pylist()]
        flat = pa.array(coded, pa.large_binary()).take(table.indices)
        body = flat.buffers()[2]
        data, ends = b"" if body is None else body.to_pybytes(), np.frombuffer(flat.buffers()[1], np.int64)
        # A text's first word has no space in front.
        cuts = split.offsets.to_numpy()
        starts, stops = ends[cuts[:-1] + 1].tolist(), ends[cuts[1:]].tolist()
        return [odd[i] if i in odd else self._unit(t.partition(" ")[0]) + data[a:b] for i, (t, a, b) in enumerate(zip(texts, starts, stops))]


class Utf8Stream:
    """Incremental UTF-8: the state is the bytes of a character that is not complete yet."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if byte & 0xC0 == 0x80:
                continue
            wanted = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            if wanted > back:
                cut -= back
            break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Decoder:
    """Token ids to text, a number of tokens at a time through the UTF-8 stream."""

    def __init__(self, ranks: dict[bytes, int], step: int = 4096):
        tokens = {v: k for k, v in ranks.items()}
        bodies = [tokens.get(i, b"") for i in range(max(tokens, default=0) + 1)]
        self.flat, self.step = np.frombuffer(b"".join(bodies), np.uint8), step
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def bytes_of(self, tokens: np.ndarray) -> bytes:
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[tokens] - (ends - sizes), sizes) + np.arange(sizes.sum())].tobytes()

    def text_of(self, tokens: np.ndarray) -> str:
        stream = Utf8Stream()
        parts = [stream.feed(self.bytes_of(tokens[i:i + self.step])) for i in range(0, len(tokens), self.step)]
        return "".join([*parts, stream.close()])


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
) -> DataFrame:
    """docs with a column of token ids (array<int>) in place of the text; with `decoded`,
    one more with the text that the ids decode to.

    Null and empty texts have no ids. Every piece of the pattern is encoded by itself and
    no special token is known. All other columns, also repeated rows, pass unchanged; ids
    must be a free name. The driver reads the rank file, one or two MB, and sends it along.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.withColumn(text, whole_text(text))
    others = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_value(("bpe", ranks_path, pattern), lambda: Encoder(ranks.value, pattern))
        decoder = worker_value(("tokens", ranks_path), lambda: Decoder(ranks.value)) if decoded else None
        for batch in slices(batches):
            coded = encoder.encode_all([t.decode() for t in texts_of(batch, text)])
            ends = np.cumsum([0, *map(len, coded)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
            added = {ids: pa.ListArray.from_arrays(ends.astype(np.int32), flat)}
            if decoded:
                added[decoded] = pa.array([decoder.text_of(np.frombuffer(c, np.int32)) for c in coded], pa.string())
            yield with_columns(batch, {text}, **added)

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{ids}` array<int>"]
    return rows.mapInArrow(run, ", ".join([*schema, f"`{decoded}` string"] if decoded else schema))


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """coded with its ids turned back into text.

    Null ids give an empty text; bytes that are no UTF-8 give replacement characters.
    """
    ranks = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    others = [f for f in coded.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_value(("tokens", ranks_path), lambda: Decoder(ranks.value))
        for batch in slices(batches):
            column = batch.column(batch.schema.get_field_index(ids))
            out = [decoder.text_of(np.array(x.as_py() or [], np.int64)) for x in column]
            yield with_columns(batch, {text}, **{text: pa.array(out, pa.string())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{text}` string"])
    return coded.mapInArrow(run, schema)


def coded_digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every text's encoding and its decoding."""
    coded = encode(docs.select(key, text), ranks_path, pattern, text, decoded="decoded")
    numbers = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def default_files(_: SparkSession | None = None) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
