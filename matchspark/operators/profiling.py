"""Tables behind exploratory charts: counts, histograms, quartiles, densities, profiles."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators import quantiles
from matchspark.session import shared_folder
from matchspark.sources.tables import spread, staged

# Weekday order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def value_counts(df: DataFrame, column: str, by: str = "count", top: int | None = None) -> DataFrame:
    """Occurrences and share of all rows per value; most frequent or smallest label first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # From the counts, whose exchange is reused, not from a second scan.
    total = counts.agg(F.sum("n").alias("total")).scalar()
    shared = counts.withColumn("share", F.round(F.col("n") / total, 4))
    order = [F.col("n").desc(), F.col(column)] if by == "count" else [F.col(column)]
    ranked = shared.orderBy(*order)
    return ranked.limit(top) if top is not None else ranked


def date_part(ts: Column, part: str) -> Column:
    if part == "weekday":
        return F.date_format(ts, "EEEE")
    return {"year": F.year, "month": F.month, "day": F.dayofmonth}[part](ts)


def datepart_counts(df: DataFrame, ts: str, part: str) -> DataFrame:
    """Counts and shares per year, month, day or weekday, in calendar order."""
    counted = value_counts(df.select(date_part(F.col(ts), part).alias("part")), "part", by="label")
    if part == "weekday":
        rank = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("part"))
        return counted.orderBy(rank)
    return counted


def histogram(df: DataFrame, column: str, bins: int = 200) -> DataFrame:
    """Equal-width bins over finite values, last bin closed, empty bins kept."""
    x = F.col(column).cast("double")
    finite = df.select(x.alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x") & (F.abs(F.col("x")) != float("inf")))
    span = finite.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("span"))
    # As numpy does: a constant column gets a unit-wide range around its value.
    bounds = span.select(F.struct(
        F.when(F.col("span.lo") == F.col("span.hi"), F.col("span.lo") - 0.5).otherwise(F.col("span.lo")).alias("lo"),
        F.when(F.col("span.lo") == F.col("span.hi"), F.col("span.hi") + 0.5).otherwise(F.col("span.hi")).alias("hi"),
    ).alias("b"))
    width = lambda b: (F.col(f"{b}.hi") - F.col(f"{b}.lo")) / bins
    counted = (
        finite.withColumn("b", bounds.scalar())
        .select(F.least(F.floor((F.col("x") - F.col("b.lo")) / width("b")), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("n"))
    )
    grid = (
        bounds.where("b.lo is not null")
        .select("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    return grid.join(counted, "bin", "left").select(
        "bin",
        (F.col("b.lo") + F.col("bin") * width("b")).alias("left_edge"),
        (F.col("b.lo") + (F.col("bin") + 1) * width("b")).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return (
        df.select(F.to_date(ts).alias("day")).where("day is not null")
        .groupBy("day").agg(F.count("*").alias("n")).orderBy("day")
    )


def top_groups(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows of the n largest groups; ties by label."""
    largest = df.groupBy(by).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), F.col(by)).limit(n)
    return df.join(F.broadcast(largest.select(by)), by, "left_semi")  # n rows


def pair_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every row with the number of rows sharing its (x, y); null where one is null.

    Counts are made by a partial aggregate and joined back, so that a very common
    pair is not gathered in one window; its rows are split by the skewed join.
    """
    counts = df.groupBy(x, y).agg(F.count("*").alias("pair_count"))
    return df.join(counts.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], "left").select(*df.columns, "pair_count")


QUARTILES = [0.25, 0.5, 0.75]


def _sketched(df: DataFrame, group: str, value: str, points: list[float]) -> tuple[DataFrame, DataFrame]:
    """Finite values (g, x) and the sketch of each group (g, s), written once."""
    rows = spread(df.select(group, value)).select(F.col(group).alias("g"), quantiles.finite(F.col(value)).alias("x"))
    rows = rows.where("g is not null and x is not null")
    return rows, staged(rows.groupBy("g").agg(quantiles.sketch(F.col("x"), points).alias("s")), "sketches")


def exact_quantiles(df: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group: (group, p, q)."""
    rows, sketches = _sketched(df, group, value, points)
    bracketed = quantiles.with_brackets(sketches, quantiles.brackets(F.col("s"), points))
    found = quantiles.placed(quantiles.counted(rows, bracketed)).groupBy("g").agg(
        F.array(*[F.struct(F.lit(p).alias("p"), quantiles.quantile(p).alias("q")) for p in points]).alias("found"))
    return found.select(F.col("g").alias(group), F.inline("found"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (1.5 IQR, at data points), extremes and outlier count per group.

    Where the quartiles lie between two values, so do the ends of the whiskers: these are
    brackets as well, and all comes from one count.
    """
    rows, sketches = _sketched(df, group, value, QUARTILES)
    first, median, third = quantiles.brackets(F.col("s"), QUARTILES)
    # A little wider, for rounding; where doubles overflow, everything.
    ends = [(2.5 * first[0] - 1.5 * third[1], 2.5 * first[1] - 1.5 * third[0]), (2.5 * third[0] - 1.5 * first[1], 2.5 * third[1] - 1.5 * first[0])]
    slack = 1e-9 * (F.abs("s.lo") + F.abs("s.hi"))
    inf = F.lit(float("inf"))
    fences = [(F.nanvl(low - slack, -inf), F.nanvl(high + slack, inf)) for low, high in ends]
    bracketed = quantiles.with_brackets(sketches, [first, median, third, *fences])
    whole = Window.partitionBy("g")
    ranked = quantiles.placed(quantiles.counted(rows, bracketed)).select(
        "*", *[quantiles.quantile(p, whole).alias(name) for p, name in zip(QUARTILES, ("q1", "median", "q3"))])
    low, high, reach = F.col("low"), F.col("high"), 1.5 * (F.col("q3") - F.col("q1"))
    bottom, top = F.col("q1") - reach, F.col("q3") + reach
    across = ((low < bottom) & (high >= bottom)) | ((low <= top) & (high > top))
    checked = F.when(across, quantiles.one_value(low)).otherwise(low)
    return (
        ranked.withColumn("low", checked).groupBy(F.col("g").alias(group), "q1", "median", "q3")
        .agg(F.sum("c").alias("n"), F.min("low").alias("lowest"), F.max("high").alias("highest"),
             F.min(F.when(low >= bottom, low)).alias("whisker_low"), F.max(F.when(high <= top, high)).alias("whisker_high"),
             F.sum(F.when((low < bottom) | (high > top), F.col("c")).otherwise(F.lit(0))).alias("outliers"))
    )


#: Terms of a cell's series, and the cell's width in bandwidths. Values are within a quarter
#: bandwidth of their cell's centre; of a value's kernel the series leaves out less than
#: sum(1.09 * 0.25 ** k / sqrt(k!) for k >= TERMS) < 1e-12.
TERMS, CELL = 13, 0.5


def density(df: DataFrame, group: str, value: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density per group on an even grid (Scott bandwidth).

    Fast Gauss sums: the line is cut into cells of half a bandwidth, and of each cell only
    the powers of its values' distances to its centre are summed (in every task, before the
    shuffle). A kernel is a series of these powers and Hermite polynomials of the grid
    point, so the work behind one pass is cells times grid points, however many values.
    """
    rows = spread(df.select(group, value)).select(F.col(group).alias("g"), quantiles.finite(F.col(value)).alias("x"))
    rows = rows.where("g is not null and x is not null")
    stats = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")
    ).where("n > 1 and sd > 0").select("g", "n", "lo", "hi", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h"))
    stats = staged(stats, "bandwidths")
    width = F.col("h") * CELL
    centre = F.col("lo") + (F.col("cell") + 0.5) * width
    apart = (
        rows.join(stats, "g").withColumn("cell", F.floor((F.col("x") - F.col("lo")) / width).cast("double"))
        .select("g", "n", "lo", "hi", "h", "cell", ((F.col("x") - centre) / F.col("h")).alias("d")))
    powers = [reduce(lambda a, _: a * F.col("d"), range(k - 1), F.col("d")) if k else F.lit(1.0) for k in range(TERMS)]
    cells = apart.groupBy("g", "n", "lo", "hi", "h", "cell").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
    grid_x = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    on_grid = (
        cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("grid_x", grid_x).withColumn("u", (F.col("grid_x") - centre) / F.col("h")))

    def hermite(k: int) -> Column:
        """The polynomial He_k of u, by Horner's rule."""
        factors = [0] * (k + 1)
        for j in range(k // 2 + 1):
            factors[k - 2 * j] = (-1) ** j * math.factorial(k) // (math.factorial(j) * math.factorial(k - 2 * j) * 2**j)
        return reduce(lambda a, c: a * F.col("u") + F.lit(float(c)), reversed(factors[:-1]), F.lit(float(factors[-1])))

    series = reduce(lambda a, b: a + b, [F.col(f"m{k}") * F.lit(1 / math.factorial(k)) * hermite(k) for k in range(TERMS)])
    return (
        on_grid.groupBy("g", "i", "grid_x", "n", "h")
        .agg(F.sum(series * F.exp(-0.5 * F.col("u") * F.col("u"))).alias("k"))
        .select(F.col("g").alias(group), F.col("i").alias("point"), "grid_x",
                (F.col("k") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2) * F.pi()))).alias("density"))
    )


NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: null share, count, distinct values of non-numbers, statistics
    and quartiles of (finite) numbers, and the number of duplicated rows of the table.

    The table is read twice: for statistics and rank sketches of all columns in one row,
    and stacked into (column, value) for one count, which holds what is between the
    sketched ranks, the distinct texts, and a digest of each row.
    """
    numeric = [f.name for f in df.schema if f.dataType.typeName() in NUMBERS]
    others = [c for c in df.columns if c not in numeric]
    number = lambda c: F.col(c).cast("double")
    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def basics(c: str) -> Column:
        x = number(c) if c in numeric else nothing
        return F.struct(
            F.lit(c).alias("g"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), quantiles.sketch(quantiles.finite(x), QUARTILES).alias("s"))

    df = spread(df)
    one_row = df.agg(F.array(*[basics(c) for c in df.columns]).alias("columns"))
    known = staged(one_row.select(F.inline("columns")), "profile")  # a row a column
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    cell = lambda g, x, t: F.struct(g.alias("g"), x.alias("x"), t.alias("t"))
    cells = [cell(F.lit(c), quantiles.finite(F.col(c)), no_text) for c in numeric]
    cells += [cell(F.lit(c), nothing, F.when(F.col(c).isNotNull(), F.to_json(F.struct(c)))) for c in others] + [cell(no_text, nothing, row)]
    stacked = df.select(F.inline(F.array(*cells))).where("x is not null or t is not null")
    bracketed = quantiles.with_brackets(known.select("g", "s"), quantiles.brackets(F.col("s"), QUARTILES))
    digests = bracketed.sparkSession.range(1).select(F.lit(None).cast("string").alias("g"), *[F.lit(None).cast("double").alias(c) for c in bracketed.columns[1:]])
    counts = staged(quantiles.counted(stacked, F.broadcast(bracketed.unionByName(digests)), ["t"]), "counts")
    quartiles = quantiles.placed(counts.where("low is not null")).groupBy("g").agg(
        *[quantiles.quantile(p).alias(name) for p, name in zip(QUARTILES, ("q1", "median", "q3"))])
    distinct = counts.where("g is not null and t is not null").groupBy("g").agg(F.count(F.lit(1)).alias("distinct_values"))
    duplicates = counts.where("g is null").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates")).scalar()
    is_text = F.col("g").isin(others) if others else F.lit(False)
    return (
        known.join(distinct, "g", "left").join(quartiles, "g", "left")
        .select(
            F.col("g").alias("column_name"), F.round(F.col("nulls") / F.col("rows") * 100, 2).alias("null_percent"),
            (F.col("rows") - F.col("nulls")).alias("filled"),
            F.when(is_text, F.coalesce("distinct_values", F.lit(0))).alias("distinct_values"),
            "mean", "std", "min", "q1", "median", "q3", "max", "rows")
        .withColumn("duplicate_rows", duplicates)
    )


def in_order(df: DataFrame, column: str, key: str, descending: bool = True) -> DataFrame:
    """Rows by a column, unknown values last either way, ties by key."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), key)


def placed(df: DataFrame, column: str, key: str, descending: bool = True) -> DataFrame:
    """All rows of in_order with their place, counted from 1.

    The sorted ranges are written once, each row with its number there; only the sizes of
    the ranges are summed in one task.
    """
    folder = f"{shared_folder(df.sparkSession)}/placed-{uuid.uuid4().hex}"
    numbered = in_order(df, column, key, descending).withColumn("_at", F.monotonically_increasing_id())
    numbered.write.parquet(folder)
    # The upper bits are the range, the lower 33 the row's number in it.
    rows = df.sparkSession.read.parquet(folder).withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "_range").select(*df.columns, place.alias("place"))
