"""Rule-based ratings: job history, requirement checks, gates and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import filters, text

# Rating by whether the role occurs in the last, second and third job.
JOB_RATINGS = {
    (True, True, True): 100, (True, True, False): 85, (True, False, True): 70,
    (True, False, False): 55, (False, True, True): 40, (False, True, False): 25,
    (False, False, True): 0, (False, False, False): 0,
}
THIRD_JOB_ONLY_OLDER = 10

# Answers that count as true.
TRUE_WORDS = ["true", "t", "yes", "y", "on", "1"]


def holds(c: Column, term: Column) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lower(term)), F.lit(False))


def job_rating(role: Column, last: Column, second: Column, third: Column, third_only: int = 0) -> Column:
    rated = F.lit(0)
    for (a, b, c), value in JOB_RATINGS.items():
        value = third_only if (a, b, c) == (False, False, True) else value
        hit = (holds(last, role) == a) & (holds(second, role) == b) & (holds(third, role) == c)
        rated = F.when(hit, F.lit(value)).otherwise(rated)
    return rated


def has_all(c: Column, wanted: Column) -> Column:
    """Every member of a comma list occurs in the text; false without text."""
    return filters.mentions_all(c, text.split_members(wanted))


def count_of(c: Column, wanted: Column) -> Column:
    """How many members of a comma list occur in the text; 0 without text."""
    hits = F.filter(text.split_members(wanted), lambda t: F.contains(F.lower(c), F.lower(t)))
    return F.coalesce(F.size(hits), F.lit(0))


def at_least_level(c: Column, wanted: Column, levels: list[str] = vocab.EDUCATION_LEVELS) -> Column:
    return F.coalesce(filters.level_rank(c, levels) >= filters.level_rank(wanted, levels), F.lit(False))


def levels_above(c: Column, wanted: Column, levels: list[str] = vocab.EDUCATION_LEVELS) -> Column:
    """Ranks above (or below) the wanted level; 0 when either is unknown."""
    return F.coalesce(filters.level_rank(c, levels) - filters.level_rank(wanted, levels), F.lit(0))


def _number(c: Column) -> Column:
    """0 unless the text is a plain number; tested by pattern, since failed casts are slow."""
    return F.when(c.rlike(r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$"), c.try_cast("double")).otherwise(F.lit(0.0))


def gate_and_sum(df: DataFrame, gates: str = "mand_", scores: str = "score_") -> DataFrame:
    """Fold answer columns: every gate must be true, scores are summed.

    Unreadable gates count as false, unreadable scores as 0; rows with no
    positive sum go. Works for any number of columns with the two prefixes.
    """
    gate_columns = [c for c in df.columns if c.lower().startswith(gates)]
    score_columns = [c for c in df.columns if c.lower().startswith(scores)]
    passed = filters.all_of(F.lower(F.trim(F.col(c).cast("string"))).isin(TRUE_WORDS) for c in gate_columns)
    total = sum((_number(F.col(c).cast("string")) for c in score_columns), F.lit(0.0))
    rest = [c for c in df.columns if c not in gate_columns + score_columns]
    return (
        df.where(passed)
        .select(*rest, F.round(total).cast("long").alias("score"))
        .where(F.col("score") > 0)
    )


def bonus_rating(role: Column, last: Column, second: Column, third: Column, bonuses: list[Column]) -> Column:
    """Older single rating: job history plus bonuses, at most 100."""
    total = sum(bonuses, job_rating(role, last, second, third, THIRD_JOB_ONLY_OLDER))
    return F.least(F.lit(100), F.coalesce(total, F.lit(0)).cast("int"))
