"""How far the sources of a language differ in their use of words: in-mapper stripes.

A partition folds whole documents into stripes in a hash table: for each term of a language
its document frequency and its occurrences in each source. A table that grows beyond a fixed
number of entries is spilled as rows and started anew; Spark merges the spilled stripes by
term. The merged stripes of terms in enough documents give every smoothed share, and from
them the divergences: the terms by which a source differs from its language, and the summed
differences of every two sources.

Sums over pairs of sources never become a row per term and pair. Sources are dealt into
blocks and terms into salts; a task has the stripes of one salt and two blocks as a matrix
of bounded size, and emits one partial sum for each pair of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.common import staged, texts_of

#: A term must be in so many documents of its language.
DOCUMENTS = 30
#: Added to each count, and the scale of shares.
PRIOR, SCALE = 5, 1_000_000_000
#: Terms reported for each source.
TOP = 50
#: Entries a task holds before it spills its stripes.
ENTRIES = 400_000
#: Expected sources in a block and terms in a salt: bounds of one matrix.
BLOCK, SALT = 64, 8192
#: Copies of a language's row that its terms are dealt to.
SLICES = 64

#: A-Z lower-cased; every other ASCII character that is no letter separates terms.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

STRIPES = "lang string, term string, entries array<struct<source:string,n:bigint>>"


def _spilled(stripes: dict[str, dict[bytes | None, dict[int, int]]], names: list[str | None]) -> Iterator[pa.RecordBatch]:
    """The stripes as rows, a bounded number at a time; source null has the document frequency."""
    for lang, table in stripes.items():
        items = list(table.items())
        for start in range(0, len(items), 16384):
            part = items[start:start + 16384]
            sizes = np.cumsum([0, *(len(s) for _, s in part)], dtype=np.int32)
            sources = pa.array([names[i] for _, s in part for i in s], pa.string())
            counts = pa.array([n for _, s in part for n in s.values()], pa.int64())
            entries = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([sources, counts], names=["source", "n"]))
            terms = pa.array([t for t, _ in part], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), terms, entries], names=["lang", "term", "entries"])


def fold(batches: Iterator[pa.RecordBatch], limit: int = ENTRIES) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, source, text) to stripes; the stripe of term null lists a language's sources."""
    names: list[str | None] = [None]
    numbers: dict[str, int] = {}
    stripes: dict[str, dict[bytes | None, dict[int, int]]] = {}
    held = 0
    for batch in batches:
        for lang, source, body in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts_of(batch, "text")):
            at = numbers.get(source)
            if at is None:
                at = numbers[source] = len(names)
                names.append(source)
            table = stripes.setdefault(lang, {})
            if at not in table.setdefault(None, {}):
                table[None][at] = 0
                held += 1
            for term, n in Counter(body.translate(FOLDED).split()).items():
                stripe = table.get(term)
                if stripe is None:
                    table[term] = {0: 1, at: n}
                    held += 2
                elif at in stripe:
                    stripe[0] += 1
                    stripe[at] += n
                else:
                    stripe[0] += 1
                    stripe[at] = n
                    held += 1
            if held > limit:
                yield from _spilled(stripes, names)
                stripes, held, names, numbers = {}, 0, [None], {}
    yield from _spilled(stripes, names)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)), without rounding; without terms there is no use of it."""
    upper = F.lit(SCALE).cast("decimal(12,0)") * (n + F.lit(PRIOR)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", upper, F.greatest(F.lit(1), total + F.lit(PRIOR) * terms).cast("decimal(20,0)"))


def kept_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", documents: int = DOCUMENTS) -> DataFrame:
    """(lang, term, source, n): occurrences of every term in at least so many documents of its
    language; the rows of term null list all sources, also those without terms. Written once."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(lang).alias("lang"), named(source).alias("source"), named(text).alias("text"))
    merged = (
        rows.mapInArrow(fold, STRIPES)
        .repartition("lang", "term").select("lang", "term", F.inline("entries"))
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    )
    # Counting, the exchange by term serves both; only the entries of one term are ever side by side.
    seen = F.max(F.when(F.col("source").isNull(), F.col("n"))).over(Window.partitionBy("lang", "term"))
    kept = merged.select("*", seen.alias("seen")).where(F.col("source").isNotNull() & (F.col("term").isNull() | (F.col("seen") >= documents)))
    return staged(kept.select("lang", "term", "source", "n"), "stripes")


def _differences(left: pa.Table, right: pa.Table) -> pa.Table:
    """Summed differences of all pairs of sources of two blocks, over the terms of one salt."""
    lang = right["lang"][0].as_py()
    lo, hi = right["lo"][0].as_py(), right["hi"][0].as_py()
    sources, block = right["source"].to_pylist(), right["block"].to_numpy()
    base, terms = right["p"].to_numpy(), int(right["terms"][0].as_py())
    place = {s: i for i, s in enumerate(sources)}
    coded = left["term"].combine_chunks().dictionary_encode()
    held = len(coded.dictionary)
    p = np.repeat(base[None, :], held, axis=0)
    if left.num_rows:
        p[coded.indices.to_numpy(), [place[s] for s in left["source"].to_pylist()]] = left["p"].to_numpy()
    first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    sums = np.empty((len(first), len(second)), np.int64)
    for i, g in enumerate(first):
        sums[i] = np.abs(p[:, second] - p[:, [g]]).sum(axis=0) + (terms - held) * np.abs(base[second] - base[g])
    ones, others = np.repeat(first, len(second)), np.tile(second, len(first))
    values = sums.ravel()
    if lo == hi:
        keep = ones != others
        ones, others, values = ones[keep], others[keep], values[keep]
    else:
        ones, others, values = np.concatenate([ones, others]), np.concatenate([others, ones]), np.concatenate([values, values])
    names = pa.array(sources, pa.string())
    return pa.table({"lang": pa.array([lang] * len(values), pa.string()), "source": names.take(pa.array(ones)), "item": names.take(pa.array(others)), "value": pa.array(values, pa.int64())})


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' has all other sources of the language,
    part 'term' the terms a source uses more than its language, the first `top` of them.

    Null text, language and source count as ''. Documents without terms, and languages in
    which no term is common enough, still give their groups (every difference is 0). Every
    row is a document, repeated rows too. Ties go to the item first in UTF-8 order. Only the
    three named columns are read; an empty table gives an empty result.
    """
    kept = kept_counts(docs, text, lang, source, documents)
    counts = kept.where(F.col("term").isNotNull())
    words = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    whole = words.groupBy("lang").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("total"))
    # One row a language: its terms and sources, and the blocks and salts they are dealt into.
    langs = (
        totals.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(whole, "lang", "left")
        .select("lang", F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("terms", F.lit(0)).alias("terms"),
                F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"),
                F.greatest(F.lit(1), F.ceil(F.col("terms") / SALT)).cast("int").alias("salts"))
    )
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    salt = F.pmod(F.xxhash64("term"), F.col("salts")).cast("int")
    groups = totals.join(langs, "lang").select("*", block.alias("block"), share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("p"))
    shares = (
        counts.where(F.col("n") > 0).join(groups.drop("p"), ["lang", "source"])
        .select("lang", "source", "term", "block", "blocks", salt.alias("salt"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    )
    tiles = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    dealt = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = shares.select("lang", "salt", "source", "term", "p", "block", dealt).select("lang", *tiles, "salt", "source", "term", "p")
    # The terms of a language are many, so each meets one of several copies of its language's row.
    slice_ = F.pmod(F.xxhash64("term"), F.lit(SLICES)).cast("int").alias("slice")
    copies = langs.select("*", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    known = words.select("*", slice_).join(copies, ["lang", "slice"])
    of_salt = known.groupBy("lang", salt.alias("salt")).agg(F.count(F.lit(1)).alias("terms"))
    right = (
        groups.select("lang", "source", "p", "block", "salts", dealt)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .join(of_salt, ["lang", "salt"], "left")
        .select("lang", *tiles, "salt", "source", "block", "p", F.coalesce("terms", F.lit(0)).alias("terms"))
    )
    tile = ["lang", "lo", "hi", "salt"]
    # Renamed to the same names: both sides come from one table and need columns of their own.
    pairs = (
        left.toDF(*left.columns).groupBy(*tile).cogroup(right.toDF(*right.columns).groupBy(*tile)).applyInArrow(_differences, "lang string, source string, item string, value bigint")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    of_lang = known.select("lang", "term", share(F.col("n"), F.col("all"), F.col("terms")).alias("q"))
    more = (
        shares.join(of_lang, ["lang", "term"]).where(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    )
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = ["lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"]
    ranked = more.select("*", place.alias("rank")).where(F.col("rank") <= top)
    return pairs.select("*", place.alias("rank")).select(*out).unionByName(ranked.select(*out[:2], F.lit("term").alias("part"), *out[3:]))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT id, lang, source,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), g AS (
  SELECT DISTINCT lang, source, false AS whole FROM d UNION ALL SELECT DISTINCT lang, '', true FROM d
), c AS (
  SELECT lang, source, false AS whole, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
  UNION ALL SELECT lang, '', true, term, count(*) FROM w JOIN k USING (lang, term) GROUP BY ALL
), t AS (
  SELECT g.lang, g.source, g.whole, k.term, coalesce(c.n, 0) AS n,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source, g.whole) AS total, count(*) OVER (PARTITION BY g.lang, g.source, g.whole) AS terms
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.whole = g.whole AND c.term = k.term
), p AS (
  SELECT lang, source, whole, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * terms) AS BIGINT) AS p FROM t
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source AND NOT a.whole AND NOT b.whole
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source AND NOT x.whole
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND NOT y.whole AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT x.lang, x.source, 'term', x.term, x.p - y.p FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND y.whole AND NOT x.whole
  WHERE x.n > 0 AND x.p > y.p
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
