"""Exact quantiles of groups in two passes: a mergeable rank sketch, then one count.

The first pass keeps a sketch of each group (Spark's approx_percentile, whose rank error is
bounded), which brackets every wanted rank by two values. The second pass counts: values
inside a bracket one by one, and those between brackets together. The wanted ranks then
are among the few counted values, however the values of a group lie, and no task sees a
whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is at most rows / ACCURACY.
ACCURACY = 100_000
#: Half a bracket's width as a share of rows: for groups of up to a million rows, and above;
#: groups of a few rows are counted whole. Each is wider than the error and two rows.
WIDE, NARROW, FEW, MANY = 0.003, 3 / ACCURACY, 1000, 1_000_000

Bracket = tuple[Column, Column]


def finite(x: Column) -> Column:
    """The value as a double, null where it is no finite number."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def sketch(x: Column, points: list[float]) -> Column:
    """Aggregate of finite values: (n, lo, hi, at), at holding the ends of all brackets."""
    ends = [min(max(p + side * width, 0.0), 1.0) for p in points for width in (WIDE, NARROW) for side in (-1, 1)]
    return F.struct(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.percentile_approx(x, ends, ACCURACY).alias("at"))


def brackets(s: Column, points: list[float]) -> list[Bracket]:
    """For each point two values that its ranks lie between."""
    def end(i: int, p: float, side: int) -> Column:
        outer = s["lo"] if side < 0 else s["hi"]
        at = lambda width, k: outer if not 0 < p + side * width < 1 else s["at"][4 * i + k + (side > 0)]
        return F.when(s["n"] <= FEW, outer).when(s["n"] <= MANY, at(WIDE, 0)).otherwise(at(NARROW, 2))

    return [(end(i, p, -1), end(i, p, 1)) for i, p in enumerate(points)]


def with_brackets(sketched: DataFrame, found: list[Bracket]) -> DataFrame:
    """(g, n, l0, h0, l1, h1, …) from (g, s)."""
    ends = [c for i, (low, high) in enumerate(found) for c in (low.alias(f"l{i}"), high.alias(f"h{i}"))]
    return sketched.select("g", F.col("s.n").alias("n"), *ends)


def counted(rows: DataFrame, bracketed: DataFrame, also: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts of (g, x): values in a bracket singly, those between brackets together, as
    (g, n, low, high, c). Rows of no value are counted by the columns of also."""
    ends = [c for c in bracketed.columns if c not in ("g", "n")]
    x = F.col("x")
    inside = reduce(lambda a, b: a | b, [(x >= F.col(low)) & (x <= F.col(high)) for low, high in zip(ends[::2], ends[1::2])])
    between = sum((F.col(e) < x).cast("int") for e in ends)
    wide = rows.join(bracketed.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
    return (
        wide.groupBy("g", "n", F.when(inside, x).alias("one"), F.when(inside, F.lit(-1)).otherwise(between).alias("between"), *also)
        .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        .select("g", "n", "low", "high", "c", *also)
    )


def placed(counts: DataFrame) -> DataFrame:
    """Counts with the rank of the first value of each row."""
    order = Window.partitionBy("g").orderBy("low")
    return counts.withColumn("first", F.sum("c").over(order) - F.col("c"))


def one_value(of: Column) -> Column:
    """The value of a row that must hold but one."""
    return F.when(F.col("low") == F.col("high"), of).otherwise(F.raise_error(F.lit("a rank fell out of its bracket")).cast("double"))


def quantile(p: float, over: Window | None = None) -> Column:
    """Linear-interpolated quantile from placed counts: an aggregate by g, or over a window."""
    at = F.lit(p) * (F.col("n") - 1)

    def value(rank: Column) -> Column:
        held = (F.col("first") <= rank) & (rank < F.col("first") + F.col("c"))
        best = F.max(F.when(held, one_value(F.col("low"))))
        return best if over is None else best.over(over)

    low, high = value(F.floor(at)), value(F.ceil(at))
    at = F.lit(p) * ((F.max("n") if over is None else F.max("n").over(over)) - 1)
    return low + (high - low) * (at - F.floor(at))
