"""Role synonyms from a dictionary (role, synonyms): normalise, match, expand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.text import alphanumeric
from matchspark.operators.skew import join_weighted

CUTOFF = 0.85
PIECE = 3


def dictionary(df: DataFrame, role: str = "role", synonyms: str = "synonyms", order: str | None = None) -> DataFrame:
    """(role_pos, role, term_pos, term) with normalised forms; a scalar synonym is a list of one."""
    listed = F.col(synonyms) if dict(df.dtypes)[synonyms].startswith("array") else F.array(synonyms)
    return (
        df.select(F.col(order or role).alias("role_pos"), F.col(role).alias("role"), F.posexplode(listed).alias("term_pos", "term"))
        .withColumns({"role_norm": alphanumeric(F.col("role")), "term_norm": alphanumeric(F.col("term"))})
    )


def _spellings(terms: DataFrame) -> DataFrame:
    """Each normalised spelling once, owned by the first role that uses it."""
    names = terms.select("role_pos", F.lit(-1).alias("term_pos"), "role", F.col("role_norm").alias("norm"))
    words = terms.select("role_pos", "term_pos", "role", F.col("term_norm").alias("norm"))
    return (
        names.unionByName(words).groupBy("norm")
        .agg(F.min_by("role", F.struct("role_pos", "term_pos")).alias("role"))
    )


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(1.0))


def _expand(matched: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_norm, role) to the synonyms of the matched roles, first seen first."""
    return (
        matched.join(terms.select("role_pos", "role", "term_pos", "term"), "role")
        .groupBy("query_norm", "term")
        .agg(F.min(F.struct("role_pos", "term_pos")).alias("pos"))
        .groupBy("query_norm")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("found"))
        .select("query_norm", F.transform("found", lambda x: x["term"]).alias("synonyms"))
    )


def _pieces(c: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the given sizes."""
    whole = [F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))
             .otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.array_distinct(F.concat(*whole))


def _keys(c: Column, cutoff: float, inner: str, outer: str) -> Column:
    """Keys under which a spelling meets those it may match.

    inner: its own beginning, found among the pieces of a spelling that contains it;
    outer: all its pieces, for those it contains itself; and for close spellings a few of
    its pieces in one fixed order: k edits leave all but 3k of a spelling's pieces alone,
    so two close spellings share one among the first 3k + 1 of each. Where that leaves none
    (below a cutoff of about 0.8, or in short spellings), lengths are the key.
    """
    begin = F.array(F.concat(F.lit(inner), F.substring(c, F.lit(1), F.lit(PIECE))))
    within = F.transform(F.array_append(_pieces(c, list(range(1, PIECE + 1))), F.lit("")), lambda x: F.concat(F.lit(outer), x))
    # The longer of a close pair is at most 1 / cutoff times as long as this one.
    edits = F.floor(F.length(c) / F.lit(cutoff) * F.lit(1 - cutoff) + F.lit(1e-9)).cast("int")
    ordered = F.array_sort(F.transform(_pieces(c, [PIECE]), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("piece"))))
    few = F.transform(F.slice(ordered, F.lit(1), PIECE * edits + 1), lambda x: F.concat(F.lit("e:"), x["piece"]))

    def unsure(size: Column) -> Column:
        """Edits may spoil every piece of a spelling of this size (short ones, or low cutoffs)."""
        allowed = F.floor(size * F.lit(1 - cutoff) + F.lit(1e-9))
        return (allowed > 0) & (size - (PIECE - 1) <= PIECE * allowed)

    # Such pairs meet by the longer one's length.
    sizes = F.filter(F.sequence(F.length(c), F.floor(F.length(c) / F.lit(cutoff) + F.lit(1e-9)).cast("int")), unsure)
    by_size = F.transform(sizes, lambda n: F.concat(F.lit("l:"), n.cast("string")))
    return F.concat(begin, within, few, by_size)


def matches(queries: DataFrame, spellings: DataFrame, cutoff: float) -> DataFrame:
    """(query_norm, role): spellings close to a query, containing it or contained in it.

    Only pairs that share a key are compared, so neither side has a limit.
    """
    q, n = F.col("query_norm"), F.col("norm")
    asked = queries.select("query_norm", F.explode(_keys(q, cutoff, "a:", "b:")).alias("_key"))
    known = spellings.select("norm", "role", F.explode(_keys(n, cutoff, "b:", "a:")).alias("_key"))
    pairs = asked.join(known, "_key").select("query_norm", "norm", "role").distinct()
    near = F.abs(F.length(q) - F.length(n)) <= (1 - cutoff) * F.greatest(F.length(q), F.length(n)) + 1e-9
    close = near & (edit_ratio(q, n) >= cutoff)
    return pairs.where(F.contains(n, q) | F.contains(q, n) | close).select("query_norm", "role").distinct()


def expand_roles(queries: DataFrame, column: str, terms: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Synonyms of every role matched by the query: close spelling, or one inside the other.

    Distinct normalised queries only are compared, with the spellings that share a piece.
    """
    keyed = queries.withColumn("query_norm", alphanumeric(F.col(column)))
    distinct = keyed.where("query_norm is not null").groupBy("query_norm").agg(F.count("*").alias("_asked"))
    matched = matches(distinct.select("query_norm"), _spellings(terms), cutoff)
    expanded = distinct.join(_expand(matched, terms), "query_norm", "left")
    total = keyed.agg(F.count("query_norm").alias("total")).scalar()
    found = join_weighted(keyed.where("query_norm is not null"), expanded, ["query_norm"], "_asked", total)
    unnamed = keyed.where("query_norm is null").withColumn("synonyms", F.lit(None).cast("array<string>"))
    return found.unionByName(unnamed)
