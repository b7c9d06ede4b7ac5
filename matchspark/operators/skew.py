"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows. There are fewer hot
# keys than 1 / share, which proves the size of what is broadcast.
HOT_SHARE = 1 / 1000
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marked for broadcast if counted to be small; otherwise left to the planner.

    Saves shuffling the large side of a dimension join, which the planner would begin
    before it has seen the size of a computed dimension.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_weighted(
    big: DataFrame, side: DataFrame, keys: list[str], weight: str, total: Column | None = None,
    finish: Callable[[DataFrame], DataFrame] = lambda part: part,
) -> DataFrame:
    """Inner join of big to one row per key, weight being how many big rows hold the key.

    Rows of hot keys meet them by broadcast and are not shuffled; all other keys
    are joined as usual. Every row takes exactly one of the two ways. total is the
    sum of weights, when a cheaper source than side gives it. finish adds columns to
    both parts of side after the cut, so that costly ones are made once per row.
    """
    if total is None:
        total = side.agg(F.sum(weight).alias("total")).scalar()
    is_hot = F.col(weight) > total * F.lit(HOT_SHARE)
    hot, cold = (finish(side.where(part).drop(weight)) for part in (is_hot, ~is_hot))
    return big.join(F.broadcast(hot), keys).unionByName(big.join(cold, keys))
