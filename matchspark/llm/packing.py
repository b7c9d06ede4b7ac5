"""Packing tokenised documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
lengths). Pieces are placed longest first; among the open sequences that have room under
every capacity, the one is taken whose residual after placing has the least weighted norm
(or whose residual has the greatest weighted dot product with the piece).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import free_name, slices, staged, texts_of, whole_text, worker_value

TOKENS = 2048
#: Sequences a group is meant to fill: large enough that its last one hardly counts.
GROUP = 1024
#: Words a worker keeps the ids of, twice at most: so many newer and so many older ones.
WORDS, CORES = 300_000, 450_000


class WordEncoder:
    """Texts to ids of a tokenizer that drops white space and never joins across it.

    Words are cut at ASCII white space, with A-Z in lower case, and looked up; new ones go
    to the tokenizer. Words of Latin-1 characters are first split as the tokenizer's own
    pattern does, so that one core serves all the words it stands in. Texts that hold one
    of the file's added tokens, which the library finds before it splits, in any case, are
    asked for by whole words as they stand; where an added token has white space or is
    looked for in normalised text, or case counts, every text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Newer and older entries: what is met again moves to the newer ones, the rest goes.
        self.cores: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.words: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
        # A line break is a part by itself: it ends a word.
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [t.lower().encode() for t in added]
        flags = [t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Tokens that only stand at the end of a word, by the file's mark of them.
        vocabulary, mark = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        normal = self.tokenizer.normalizer
        folds = normal is not None and normal.normalize_str("A\xc9Z") == "a\xe9z"
        self.uncut = any(flags) or any(t.split() != [t] or not t.isascii() for t in added) or not folds

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _ask_cores(self, cores: list[str]) -> list[bytes]:
        """As _ask, some hundred cores in one text where the last token of a core can be told."""
        if not self.ends.any():
            return self._ask(cores)
        out: list[bytes] = []
        step = 512
        joined = [" ".join(cores[i:i + step]) for i in range(0, len(cores), step)]
        for n, found in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            own = cores[n * step:(n + 1) * step]
            if len(ends) == len(own):
                body = ids.tobytes()
                out += [body[i:j] for i, j in zip([0, *ends], ends)]
            else:
                out += self._ask(own)
        return out

    def _cores(self, wanted: set[str]) -> dict[str, bytes]:
        known, older = self.cores
        fresh = []
        for core in wanted.difference(known):
            ids = older.get(core)
            if ids is None:
                fresh.append(core)
            else:
                known[core] = ids
        known.update(zip(fresh, self._ask_cores(fresh)))
        if len(known) > CORES:  # the ones met since the last time stay
            self.cores = ({}, known)
        return known

    def learn(self, words: list[bytes]) -> None:
        """Different words, A-Z in lower case, without an added token."""
        known, older = self.words
        fresh = []
        for word in words:
            ids = older.get(word)
            if ids is None:
                fresh.append(word)
            else:
                known[word] = ids
        texts = [w.decode() for w in fresh]
        whole = [i for i, t in enumerate(texts) if not self.plain.fullmatch(t)] if not self.plain.fullmatch("".join(texts) or "-") else []
        if whole:
            known.update(zip([fresh[i] for i in whole], self._ask([texts[i] for i in whole])))
            left = sorted(set(range(len(fresh))).difference(whole))
            fresh, texts = [fresh[i] for i in left], [texts[i] for i in left]
        texts = "\n".join(texts).lower().split("\n")
        mixed = [(w, t) for w, t in zip(fresh, texts) if not t.isalpha()]
        parts = self.parts.findall("\n".join([t for _, t in mixed]))
        wanted = {t for t in texts if t.isalpha()}
        wanted.update(parts)
        wanted.discard("\n")
        cores = self._cores(wanted)
        known.update([(w, cores[t]) for w, t in zip(fresh, texts) if t.isalpha()])
        coded = iter([cores.get(p) for p in parts])
        for word, _ in mixed:
            known[word] = b"".join(takewhile(lambda c: c is not None, coded))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, 32 bit little-endian."""
        if self.uncut:
            return self._ask([t.decode() for t in texts])
        small = [t.lower() for t in texts]
        odd = {i: b"".join(self._ask([w.decode() for w in texts[i].split()])) for i, t in enumerate(small) if any(a in t for a in self.added)}
        split = pc.ascii_split_whitespace(pa.array([b"" if i in odd else t for i, t in enumerate(small)], pa.large_string()))
        table = split.flatten().dictionary_encode()
        words = table.dictionary.view(pa.large_binary()).to_pylist()
        if len(self.words[0]) > WORDS:
            self.words = ({}, self.words[0])
        known = self.words[0]
        coded = list(map(known.get, words))
        fresh = [w for w, c in zip(words, coded) if c is None]
        if fresh:
            self.learn(fresh)
            coded = [known[w] if c is None else c for w, c in zip(words, coded)]
        flat = pa.array(coded, pa.large_binary()).take(table.indices)
        body = flat.buffers()[2]
        ends = np.frombuffer(flat.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        data = body.to_pybytes() if body is not None else b""
        return [odd[i] if i in odd else data[a:b] for i, (a, b) in enumerate(zip(ends, ends[1:]))]


def tokenise(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = TOKENS, end: int = 0,
) -> DataFrame:
    """key, piece, start, length, ids (binary, unsigned 32 bit little-endian): each text's
    ids and the end id, cut into pieces of at most size tokens.

    A null or empty text is its end id alone. Other columns are dropped; a repeated row
    has its own pieces. path is a file of the tokenizers library, the same on all machines;
    its contents are read by the driver and sent along.
    """
    with open(path) as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(key), whole_text(text).alias("_text"))
    kind = rows.schema[key].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def make() -> WordEncoder:
        import os
        import tempfile

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # The library reads files; the copy is gone once it is read.
        with tempfile.NamedTemporaryFile("w", suffix=".json") as copy:
            copy.write(content.value)
            copy.flush()
            return WordEncoder(copy.name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_value(("words", path), make)
        for batch in slices(batches):
            row, piece, start, length, ids = [], [], [], [], []
            for i, coded in enumerate(encoder.encode(texts_of(batch, "_text"))):
                coded += last
                for p, at in enumerate(range(0, len(coded), 4 * size)):
                    body = coded[at:at + 4 * size]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(body) // 4)
                    ids.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch[key].take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=[key, "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def best_fit(
    lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str,
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of one group.

    Open sequences are kept as rows of residual capacities; one whose tokens are used up
    is closed. rule is 'norm' (least weighted norm of what is left) or 'dot' (greatest
    weighted dot product of the piece's needs and the room). Ties take the oldest sequence.
    """
    full = np.array(capacity, float)
    scale = np.array(weights, float) / full**2
    needs = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    least = int(lengths.min(initial=0))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, names, n, made = np.empty((1024, 3)), np.empty(1024, np.int64), 0, 0
    for i in order:
        need = needs[i]
        fits = np.flatnonzero((room[:n, 0] >= need[0]) & (room[:n, 1] >= need[1]) & (room[:n, 2] >= need[2]))
        if len(fits):
            left = room[fits]
            score = (((left - need) ** 2) @ scale) if rule == "norm" else -((left * need) @ scale)
            at = fits[np.argmin(score)]
        else:
            if n == len(room):
                room, names = np.concatenate([room, np.empty_like(room)]), np.concatenate([names, np.empty_like(names)])
            at = n
            room[at], names[at] = full, made
            n, made = n + 1, made + 1
        bins[i], offsets[i] = names[at], int(full[0] - room[at, 0])
        room[at] -= need
        if room[at, 0] < least or room[at, 1] < 1:
            # No piece still to come fits: the last open sequence takes the place.
            n -= 1
            room[at], names[at] = room[n], names[n]
    return bins, offsets


def pack(
    pieces: DataFrame, size: int = TOKENS, documents: int = TOKENS, attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm", group: int = GROUP,
) -> DataFrame:
    """pieces (a long column length is needed) with sequence_id and offset.

    Pieces are dealt at random (by a hash of their columns) into groups that fill about
    `group` sequences each, and every group is packed by itself, so a task's memory doesn't
    grow with the table; what is lost is less than one sequence a group. Every piece is
    placed; a piece longer than size, or null or negative lengths, raise. Offsets within a
    sequence leave no gaps. An empty table gives an empty result. Columns already named
    sequence_id or offset are replaced.
    """
    attention = float(size) ** 2 if attention is None else attention
    capacity = (float(size), float(documents), float(attention))
    groups = pieces.agg(F.greatest(F.ceil(F.sum("length") / F.lit(size * group)), F.lit(1)).alias("n")).scalar()
    pieces = pieces.drop("sequence_id", "offset")
    dealing = free_name(pieces, "_group")
    dealt = pieces.withColumn(dealing, F.pmod(F.xxhash64(*pieces.columns), F.coalesce(groups, F.lit(1))))

    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        if len(lengths) and (lengths.min() < 0 or lengths.max() > size or lengths.max() ** 2 > attention):
            raise ValueError("a piece is longer than a sequence may be")
        bins, offsets = best_fit(lengths, capacity, weights, rule)
        sequence = (table[dealing].to_numpy() << 32) + bins
        return table.drop_columns([dealing]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "sequence_id long, offset long"])
    return dealt.groupBy(dealing).applyInArrow(run, schema)


def packed_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = tokenise(docs, path, key, text).select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(staged(pieces, "pieces"))


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
