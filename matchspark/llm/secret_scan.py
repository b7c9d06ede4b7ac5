"""Secrets in texts, told apart by how many owners share them.

Candidate strings are found by pattern. The corpus is then asked, for each candidate's
hash, in how many repositories and of how many owners it stands: what many owners share is
a copied example, what few own looks live. Strings without a tell-tale context count as
secrets only if they look live; those with one always count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.once import let
from matchspark.llm.common import free_name, row_identity, staged, whole_text

#: Fixed values of the contract: kinds in the order in which equal starts are listed.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs of the right length; shorter ones would be dropped anyway, and hold no longer one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: The method's own kind: long runs of letters and digits without context.
BARE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "bare")
#: A string of more owners than this is a copied example.
OWNERS = 2

SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


#: Code points of the pieces in which a text is taken apart.
PIECE = 1024


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers what it and all before it combine to (a sum, a maximum).

    Blocks of about the square root of the size are folded one by one, then their totals:
    an append copies the array it extends, so one fold over n values would copy n * n / 2.
    """
    def fold(part: Column, of: Callable[[Column], Column]) -> Column:
        def step(done: Column, x: Column) -> Column:
            return F.array_append(done, F.coalesce(combine(F.try_element_at(done, F.lit(-1)), of(x)), of(x)))

        return F.aggregate(part, F.array().cast("array<int>"), step)

    def blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda i: F.slice(v, i * size + 1, size))

    def carried(parts: Column, totals: Column) -> Column:
        def with_earlier(part: Column, j: Column) -> Column:
            return F.transform(part, lambda x: F.coalesce(combine(F.get(totals, j - 1), x), x))

        return F.flatten(F.transform(parts, with_earlier))

    def whole(v: Column) -> Column:
        parts = F.transform(blocks(v), lambda part: fold(part, lambda x: x))
        return let(parts, lambda p: let(fold(p, lambda part: F.element_at(part, -1)), lambda totals: carried(p, totals)))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(whole(v)))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _located(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches with their places in code points: what stands between them gives the distances."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def places(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(between, found, lambda gap, match: F.length(gap) + F.length(match))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        rows = F.arrays_zip(running(steps, lambda a, b: a + b).alias("stop"), found.alias("whole"), values.alias("value"))
        return F.transform(rows, lambda r: F.struct(
            (r["stop"] - F.length(r["whole"])).alias("start"), F.lit(kind).alias("kind"), r["stop"].alias("stop"), r["value"].alias("value")))

    return let(whole, lambda found: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(places(found)))


def _apart(bare: Column, base: Column) -> Column:
    """Spans of bare that overlap none of base (kinds before it)."""
    last = F.lit(KINDS.index("bare"))

    def free(spans: Column) -> Column:
        before = running(F.transform(spans, lambda s: F.when(s["kind"] < last, s["stop"]).otherwise(F.lit(0))), _larger)
        starts = F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < last, s["start"]).otherwise(F.lit(2**31 - 1)))
        behind = F.reverse(running(starts, lambda a, b: F.least(a, b)))
        rows = F.arrays_zip(spans.alias("span"), before.alias("before"), behind.alias("behind"))
        kept = F.filter(rows, lambda r: (r["span"]["kind"] == last) & (r["before"] <= r["span"]["start"]) & (r["behind"] >= r["span"]["stop"]))
        return F.transform(kept, lambda r: r["span"])

    both = F.array_sort(F.concat(base, bare))
    return F.when((F.size(bare) == 0) | (F.size(base) == 0), bare).otherwise(let(both, free))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with each group of overlapping spans (sorted) replaced by the mark."""
    def rebuilt(pieces: Column, stops: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
            return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), a - first * PIECE + 1, b - a)

        def one(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(stops, i - 1), F.lit(0))
            return F.when(s["start"] >= at, F.concat(part(at, s["start"]), F.lit(mark))).otherwise(F.lit(""))

        rest = part(F.element_at(stops, -1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    stops = running(F.transform(spans, lambda s: s["stop"]), _larger)
    return let(pieces, lambda p: let(stops, lambda ends: rebuilt(p, ends)))


def _if_has(text: Column, words: tuple[str, ...], found: Column) -> Column:
    """found, where one of the words its pattern needs is there at all."""
    has = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return F.when(has, found).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def find_candidates(docs: DataFrame, key: str, text: str, owner: str, repository: str) -> DataFrame:
    """One row per row: key, rid, owner, repository, base (the contract's spans) and bare spans."""
    rows = docs.select(
        F.col(key), row_identity(key, text).alias("rid"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), whole_text(text).alias("_t"))
    t = F.col("_t")
    assign = F.filter(_located(t, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 12)
    base = F.concat(
        _if_has(F.lower(t), WORDS, assign), _if_has(t, ("AKIA",), _located(t, ACCESS, 1)), _located(t, HEX, 2))
    bare = F.filter(_located(t, BARE, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    found = rows.select(key, "rid", "owner", "repository", F.array_sort(base).alias("base"), bare.alias("bare"))
    return found.withColumn("bare", _apart(F.col("bare"), F.col("base")))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate, over all rows: equal rows of a task
    merge before each shuffle, so a string in a third of all rows is no hot key."""
    return (
        candidates.select("hash", "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    )


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id",
    most_owners: int = OWNERS,
) -> DataFrame:
    """One row per row of docs: key, rid, base, spans (arrays of start, kind, stop, value),
    n_live and n_copied.

    spans holds all base spans and, of the bare ones that overlap none, those that at most
    most_owners owners share; n_live and n_copied count all spans' strings with at most and
    with more owners. Null and empty texts have none; a null owner or repository counts as
    one named ''. Rows with equal key and text count as one repository's. Other columns
    are not read; an empty table gives an empty result.
    """
    found = staged(find_candidates(docs, key, text, owner, repository), "candidates")
    none = F.size("base") + F.size("bare") == 0
    each = found.where(~none).select("rid", "owner", "repository", F.explode(F.concat("base", "bare")).alias("s"))
    each = each.withColumn("hash", F.sha2(F.col("s.value"), 256))
    shared = ownership(each)
    live = F.col("owners") <= most_owners
    judged = each.select("rid", "hash", "s").join(shared, "hash").select("rid", "s", live.alias("live"))
    kept = F.when(F.col("live") | (F.col("s.kind") < KINDS.index("bare")), F.col("s"))
    marks = judged.distinct().groupBy("rid").agg(
        F.array_sort(F.collect_list(kept)).alias("spans"), F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"))
    with_some = found.where(~none).join(marks, "rid").select(key, "rid", "base", "spans", "n_live", "n_copied")
    without = found.where(none).select(
        key, "rid", "base", F.array().cast(SPAN).alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return with_some.unionByName(without)


def scan_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    return scan(docs).select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        "n_live", "n_copied")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of secrets replaced by a mark (overlapping spans by one).

    Texts without spans, null ones among them, stay as they are; so do other columns.
    """
    rid, found = free_name(docs, "_rid"), free_name(docs, "_spans")
    spans = scan(docs, key, text).where(F.size("spans") > 0).select(F.col("rid").alias(rid), F.col("spans").alias(found)).dropDuplicates([rid])
    t = F.col(text)
    clean = F.when(F.col(found).isNull(), t).otherwise(_without(t, F.col(found), mark))
    return docs.withColumn(rid, row_identity(key, text)).join(spans, rid, "left").withColumn(text, clean).select(docs.columns)


#: DuckDB's form of the scan over `documents`.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(source, '') AS owner, coalesce(CAST(doc_id AS VARCHAR), '') AS repository,
         coalesce(text, '') AS t FROM documents
), m AS (
  SELECT n, 0 AS kind, regexp_extract_all(t, $a$, 0) AS whole, regexp_extract_all(t, $a$, 2) AS vals, string_split_regex(t, $a$) AS gaps FROM d
  UNION ALL SELECT n, 1, regexp_extract_all(t, $b$), regexp_extract_all(t, $b$), string_split_regex(t, $b$) FROM d
  UNION ALL SELECT n, 2, regexp_extract_all(t, $c$), regexp_extract_all(t, $c$), string_split_regex(t, $c$) FROM d
  UNION ALL SELECT n, 3, regexp_extract_all(t, $d$), regexp_extract_all(t, $d$), string_split_regex(t, $d$) FROM d
), u AS (SELECT n, kind, whole, vals, gaps, unnest(range(1, len(whole) + 1)) AS i FROM m), s AS (
  SELECT n, kind, vals[i] AS value, length(whole[i]) AS size,
         coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start FROM u
), b AS (SELECT n, kind, value, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop FROM s
  WHERE (kind = 0 AND length(value) >= 12) OR kind IN (1, 2)
), e AS (
  SELECT n, kind, value, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop FROM s
  WHERE kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.n = s.n AND b.start < s.start + s.size AND s.start < b.stop)
), c AS (SELECT * FROM b UNION ALL SELECT * FROM e
), o AS (SELECT value, count(DISTINCT owner) AS owners FROM c JOIN d USING (n) GROUP BY value
), j AS (SELECT c.*, owners <= 2 AS live, list_extract(['assign', 'access', 'hex', 'bare'], kind + 1) || ':' || start || ':' || stop AS name
  FROM c JOIN o USING (value)
), r AS (
  SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM j GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN r USING (n)
"""
for _name, _pattern in (("$a$", ASSIGN), ("$b$", ACCESS), ("$c$", HEX), ("$d$", "[A-Za-z0-9+/_-]{20,}")):
    SQL = SQL.replace(_name, "'" + _pattern.replace("'", "''") + "'")
