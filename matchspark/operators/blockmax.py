"""Search over postings with block maxima, so that most documents are never scored.

Documents are numbered within shards of bounded size. A shard's postings of a token are cut
at every RANGE document numbers, and each such block states its highest frequency and least
document length: a bound on what any document in it can gain, whatever the weights. A query
walks the ranges of a shard in the order of their bounds and stops when the next ones can't
reach its best k. With vectors there are two such orders, by words and by meaning, and the
walk stops when what is left of both together can't (a threshold algorithm on ranges).

Only the best k of each query leave a task; no (query, document) pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.text import tokens

# Usual BM25 parameters.
K1 = 1.2
B = 0.75

#: Documents of a shard at most, tokens beyond which it is closed, documents of a range, queries of a block.
DOCUMENTS, TOKENS, RANGE, QUERIES = 8192, 4_000_000, 64, 256
#: Scores that differ by less may be equal when rounded to nine decimals.
NEAR = 1e-8

POSTING = "token string, docs array<int>, tfs array<int>, ranges array<int>, ends array<int>, most_tf array<int>, least_len array<int>"


def index_schema(key_type: str) -> str:
    """Rows of a token hold its postings in a shard; the row without token lists the shard's documents."""
    return f"shard long, {POSTING}, keys array<{key_type}>, lens array<int>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.astype(np.int32)))


def shard_rows(shard: int, keys: pa.Array, lens: np.ndarray, names: pa.Array, token: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """The rows of one shard; token (numbers into names) and doc are sorted in this order."""
    ranges = doc // RANGE
    first_of_token = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (ranges[1:] != ranges[:-1])]) if len(token) else first_of_token
    ends = np.r_[first_of_token[1:], len(token)] if len(token) else first_of_token
    block_ends = np.searchsorted(first, ends)
    start = np.repeat(first_of_token, np.diff(np.r_[0, block_ends]))
    most = np.maximum.reduceat(tf, first) if len(first) else tf
    least = np.minimum.reduceat(lens[doc], first) if len(first) else tf
    n = len(ends)
    nothing = lambda kind: pa.nulls(n, kind)
    ints = pa.list_(pa.int32())
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = {
        "shard": pa.array(np.full(n + 1, shard)),
        "token": pa.concat_arrays([names.take(pa.array(token[first_of_token])).cast(pa.string()), pa.nulls(1, pa.string())]),
        "docs": _lists(doc, ends), "tfs": _lists(tf, ends), "ranges": _lists(ranges[first], block_ends),
        "ends": _lists(np.r_[first[1:], len(token)][:len(first)] - start, block_ends),
        "most_tf": _lists(most, block_ends), "least_len": _lists(least, block_ends),
    }
    for name in ("docs", "tfs", "ranges", "ends", "most_tf", "least_len"):
        columns[name] = pa.concat_arrays([columns[name], pa.nulls(1, ints)])
    columns["keys"] = pa.concat_arrays([nothing(pa.list_(keys.type)), one(keys)])
    columns["lens"] = pa.concat_arrays([nothing(ints), one(pa.array(lens.astype(np.int32)))])
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _indexer(words: list[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    wanted = None if words is None else pa.array(sorted(words), pa.string())

    def closed(shard: int, parts: list[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
        keys = pa.concat_arrays([p[0] for p in parts])
        lens = np.concatenate([p[1] for p in parts])
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        doc = np.concatenate([p[2] + s for p, s in zip(parts, shift)])
        if wanted is None:
            coded = pa.concat_arrays([p[3] for p in parts]).dictionary_encode()
            names, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            names, number = wanted, np.concatenate([p[3].to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        pairs, tf = np.unique(number * len(keys) + doc, return_counts=True)
        return shard_rows(shard, keys, lens, names, pairs // len(keys), pairs % len(keys), tf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, parts, held, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lens = pc.fill_null(pc.list_value_length(batch["words"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat, doc = batch["words"].flatten().cast(pa.string()), np.repeat(np.arange(len(lens)), lens)
                if wanted is not None:
                    flat = pc.index_in(flat, wanted)
                    known = flat.is_valid().to_numpy(zero_copy_only=False)
                    flat, doc = flat.drop_null(), doc[known]
                if held and (held + len(lens) > DOCUMENTS or size + len(flat) > TOKENS):
                    yield closed(base, parts)
                    base, parts, held, size = base + 1, [], 0, 0
                parts.append((batch["key"], lens, doc, flat))
                held, size = held + len(lens), size + len(flat)
        if held:
            yield closed(base, parts)

    return run


def block_index(docs: DataFrame, key: str, text: str, words: list[str] | None = None) -> DataFrame:
    """Postings with block maxima of all documents, or of some tokens of them.

    Keys are unique; a null text has no words. Nothing is shuffled: a shard is made of
    documents that lie in one partition.
    """
    rows = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words"))
    return rows.mapInArrow(_indexer(words), index_schema(rows.schema["key"].dataType.simpleString()))


def index_of_postings(postings: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """The same from stored rows (key, token, tf, doc_len) and (key, doc_len)."""
    shards = -(-lengths.count() * 2 // DOCUMENTS) or 1
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    kind = lengths.schema[key].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, lens = right["key"].combine_chunks(), right["doc_len"].combine_chunks()
        lens = pc.fill_null(lens, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = left["token"].combine_chunks().cast(pa.string()).dictionary_encode()
        token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = pc.index_in(left["key"].combine_chunks(), keys).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((doc, token))
        rows = shard_rows(right["shard"][0].as_py(), keys, lens, coded.dictionary, token[order], doc[order], left["tf"].to_numpy()[order].astype(np.int64))
        return pa.Table.from_batches([rows])

    left = postings.select(F.col(key).alias("key"), "token", "tf").select(shard, "key", "token", "tf")
    right = lengths.select(F.col(key).alias("key"), "doc_len").select(shard, "key", "doc_len")
    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(run, index_schema(kind))


def frequencies(index: DataFrame) -> DataFrame:
    """(token, df) of an index."""
    return index.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum(F.size("docs").cast("long")).alias("df"))


def totals(index: DataFrame) -> DataFrame:
    """One row: documents and mean length."""
    added = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = index.where(F.col("token").isNull()).select(F.size("keys").cast("long").alias("docs"), added.alias("words"))
    return shards.agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("mean_len"))


def _values(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin and the last ends."""
    column = table[name].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(sizes)]


class Shard:
    """A shard's postings as flat arrays: blocks of all tokens, and their postings."""

    def __init__(self, left: pa.Table, lens: np.ndarray, mean_len: float):
        self.row = {t: i for i, t in enumerate(left["token"].to_pylist())}
        self.docs, rows_at = _values(left, "docs")
        tfs, _ = _values(left, "tfs")
        self.ranges, self.blocks_at = _values(left, "ranges")
        ends, _ = _values(left, "ends")
        most, _ = _values(left, "most_tf")
        least, _ = _values(left, "least_len")
        self.end = ends + np.repeat(rows_at[:-1], np.diff(self.blocks_at))
        self.start = np.r_[0, self.end[:-1]]
        gain = lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_len))
        self.gain = gain(tfs, lens[self.docs])
        self.bound = gain(most, least)
        self.n = len(lens)
        self.n_ranges = -(-self.n // RANGE)

    def of_query(self, terms: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of a query's words, and the weight of each."""
        found = [(self.row[t], w) for t, w in terms if t in self.row]
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        spans = [np.arange(self.blocks_at[i], self.blocks_at[i + 1]) for i, _ in found]
        return np.concatenate(spans), np.repeat([w for _, w in found], [len(s) for s in spans])

    def scores(self, blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the documents gain from some blocks."""
        sizes = self.end[blocks] - self.start[blocks]
        at = np.repeat(self.start[blocks] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        return np.bincount(self.docs[at], weights=self.gain[at] * np.repeat(weights, sizes), minlength=self.n)


def best_in_shard(
    shard: Shard, terms: list[tuple[str, float]], meaning: np.ndarray | None, known: np.ndarray | None,
    allowed: np.ndarray | None, place: np.ndarray, limit: int, looked_at: list[int] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of a query's best documents in a shard, by rounded score and place.

    meaning is what each document gains from its vector, known whether it has one. A document
    takes part if it has a word of the query or a vector, and is allowed.
    """
    blocks, weights = shard.of_query(terms)
    by_words = np.bincount(shard.ranges[blocks], weights=weights * shard.bound[blocks], minlength=shard.n_ranges)
    by_meaning = np.zeros(shard.n_ranges)
    if meaning is not None:
        can = meaning if allowed is None else np.where(allowed, meaning, -np.inf)
        # Without a vector a document gains nothing, so a range's best is 0 at least if one lacks it.
        by_meaning = np.maximum.reduceat(can, np.arange(0, shard.n, RANGE))
    if meaning is None:
        lists = [np.argsort(-by_words, kind="stable")[:int((by_words > 0).sum())]]
    else:
        lists = [np.argsort(-by_words, kind="stable"), np.argsort(-by_meaning, kind="stable")]
    done = np.zeros(shard.n_ranges, bool)
    total = np.zeros(shard.n) if meaning is None else meaning.copy()
    hit = np.zeros(shard.n, bool)
    best, kth, at, step = np.empty(0, np.int64), -np.inf, 0, 2
    while at < len(lists[0]):
        if sum(b[order[at]] for b, order in zip((by_words, by_meaning), lists)) < kth - NEAR:
            break
        new = np.zeros(shard.n_ranges, bool)
        for order in lists:
            new[order[at:at + step]] = True
        new &= ~done & (by_words + by_meaning >= kth - NEAR)
        at, step = at + step, step * 2
        if not new.any():
            continue
        done |= new
        inside = new[shard.ranges[blocks]]
        words = shard.scores(blocks[inside], weights[inside])
        total += words
        of_new = np.repeat(new, RANGE)[:shard.n]
        hit |= words > 0
        if looked_at is not None:
            looked_at.append(int(of_new.sum()))
        part = of_new & (hit if known is None else hit | known)
        if allowed is not None:
            part &= allowed
        best = np.r_[best, np.flatnonzero(part)]
        rounded = np.round(total[best], 9)
        best = best[np.lexsort((place[best], -rounded))[:limit]]
        if len(best) == limit:
            kth = total[best].min()
    return best, total[best]


def best_documents(
    index: DataFrame, queries: DataFrame, terms: DataFrame, n_queries: int, mean_len: float, limit: int, doc_key: str, query_key: str,
    weight: float = 0.0, doc_vectors: DataFrame | None = None, allowed: DataFrame | None = None,
) -> DataFrame:
    """(query, document, score): each shard's best documents for each query.

    queries: (query_key, terms array<struct<token, idf>>, vector), and their terms again as
    rows (query_key, token). doc_vectors: (doc_key, doc_vector), one a document. allowed:
    (doc_key) of the documents that may be found, all if None. Queries go to the shards in
    blocks of bounded size; one block is sent to where the shards lie.
    """
    shards = index.where(F.col("token").isNull()).select("shard", "keys", "lens")
    places = shards.select("shard", F.posexplode("keys").alias("pos", doc_key))

    def gathered(rows: DataFrame | None, value: Column, kind: str, name: str) -> DataFrame:
        if rows is None:
            return shards.withColumn(name, F.lit(None).cast(kind))
        mine = places.join(rows, doc_key).groupBy("shard").agg(F.collect_list(value).alias(name))
        return shards.join(mine, "shard", "left")

    vector_type = "array<float>" if doc_vectors is None else doc_vectors.schema["doc_vector"].dataType.simpleString()
    shards = gathered(doc_vectors, F.struct("pos", "doc_vector"), f"array<struct<pos:int,doc_vector:{vector_type}>>", "vectors")
    if allowed is None:
        shards = shards.withColumn("allowed", F.lit(None).cast("array<int>"))
    else:
        mine = places.join(allowed.select(doc_key).distinct(), doc_key).groupBy("shard").agg(F.collect_list("pos").alias("allowed"))
        shards = shards.join(mine, "shard", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<int>")))
    blocks = -(-n_queries // QUERIES) or 1
    qblock = F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int").alias("qblock")
    sets = queries.groupBy(qblock).agg(F.collect_list(F.struct(F.col(query_key).alias("query"), "terms", "vector")).alias("queries"))
    words = terms.select(qblock, "token").distinct()
    left = index.where(F.col("token").isNotNull()).select("shard", *(p.split()[0] for p in POSTING.split(", "))).join(words, "token")
    # The stated set of queries, in blocks, meets every shard.
    right = shards.crossJoin(F.broadcast(sets) if blocks == 1 else sets)
    q_type, d_type = queries.schema[query_key].dataType, index.schema["keys"].dataType.elementType

    def run(postings: pa.Table, meta: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "number": [], "score": []}
        keys = meta["keys"].combine_chunks()
        keys = keys.chunk(0).flatten() if isinstance(keys, pa.ChunkedArray) else keys.flatten()
        lens = np.array(meta["lens"][0].as_py(), np.int64)
        shard = Shard(postings, lens, mean_len)
        place = np.empty(shard.n, np.int64)
        place[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(shard.n)
        may = None
        if meta["allowed"][0].is_valid:
            may = np.zeros(shard.n, bool)
            may[meta["allowed"][0].as_py()] = True
        matrix = known = None
        if meta["vectors"][0].is_valid:
            held = [v for v in meta["vectors"][0].as_py() if v["doc_vector"] is not None]
            if held:
                at = np.array([v["pos"] for v in held])
                matrix = np.zeros((shard.n, len(held[0]["doc_vector"])))
                matrix[at] = np.array([v["doc_vector"] for v in held], float)
                known = np.zeros(shard.n, bool)
                known[at] = True
                lengths = np.sqrt((matrix**2).sum(axis=1))
        for q in meta["queries"][0].as_py():
            meaning = None
            if matrix is not None and q["vector"] is not None:
                vector = np.array(q["vector"], float)
                meaning = weight * (matrix @ vector) / (lengths * np.sqrt((vector**2).sum()) + 1e-9)
            terms = [(t["token"], t["idf"]) for t in q["terms"] or ()]
            if not terms and meaning is None:
                continue
            best, score = best_in_shard(shard, terms, meaning, known if meaning is not None else None, may, place, limit)
            found["query"] += [q["query"]] * len(best)
            found["number"].append(best)
            found["score"].append(score)
        numbers = np.concatenate([*found["number"], np.empty(0, np.int64)]).astype(np.int64)
        scores = np.concatenate([*found["score"], np.empty(0)])
        return pa.table({"query": pa.array(found["query"], meta.schema.field("queries").type.value_type.field("query").type),
                         "document": keys.take(pa.array(numbers)), "score": pa.array(scores)})

    out = (
        left.toDF(*left.columns).groupBy("shard", "qblock").cogroup(right.toDF(*right.columns).groupBy("shard", "qblock"))
        .applyInArrow(run, f"query {q_type.simpleString()}, document {d_type.simpleString()}, score double")
    )
    return out.select(F.col("query").alias(query_key), F.col("document").alias(doc_key), "score")
