"""Profiling and checks on the driver tables."""

from pyspark.sql import functions as F

from matchspark.operators import conformance, profiling
from matchspark.plans.registry import query
from matchspark.sources.tables import read_table


@query("value_counts", """
    SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1
""")
def value_counts(spark, sf):
    return profiling.value_counts(read_table(spark, sf, "orders"), "o_orderpriority")


@query("value_counts_top", """
    SELECT o_custkey, n, share FROM (
        SELECT o_custkey, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1)
    ORDER BY n DESC, o_custkey LIMIT 10
""")
def value_counts_top(spark, sf):
    return profiling.value_counts(read_table(spark, sf, "orders"), "o_custkey", top=10)


@query("datepart_counts", """
    SELECT dayname(o_orderdate) AS part, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1
""")
def datepart_counts(spark, sf):
    return profiling.datepart_counts(read_table(spark, sf, "orders"), "o_orderdate", "weekday")


@query("datepart_counts_month", """
    SELECT CAST(month(l_shipdate) AS INTEGER) AS part, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM lineitem GROUP BY 1
""")
def datepart_counts_month(spark, sf):
    return profiling.datepart_counts(read_table(spark, sf, "lineitem"), "l_shipdate", "month")


@query("histogram", """
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 200)), 199) AS INTEGER) AS bin, count(*) AS n
          FROM lineitem CROSS JOIN b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 200, 6) AS left_edge, round(lo + (i + 1) * (hi - lo) / 200, 6) AS right_edge,
        coalesce(n, 0) AS n
    FROM b CROSS JOIN range(200) r(i) LEFT JOIN c ON bin = i
""")
def histogram(spark, sf):
    h = profiling.histogram(read_table(spark, sf, "lineitem"), "l_extendedprice")
    return h.select("bin", F.round("left_edge", 6).alias("left_edge"), F.round("right_edge", 6).alias("right_edge"), "n")


@query("daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts(spark, sf):
    return profiling.daily_counts(read_table(spark, sf, "events"), "ts")


@query("box_stats", """
    WITH q AS (
        SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
            quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n, min(l_extendedprice) AS lowest,
        max(l_extendedprice) AS highest,
        min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_low,
        max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_high,
        count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM lineitem JOIN q USING (l_returnflag) GROUP BY ALL
""")
def box_stats(spark, sf):
    b = profiling.box_stats(read_table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("top_groups", """
    SELECT event_id, user_id, value FROM events WHERE user_id IN (
        SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 5)
""")
def top_groups(spark, sf):
    return profiling.top_groups(read_table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", 5)


@query("pair_counts", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, count(*) OVER (PARTITION BY l_quantity, l_discount) AS pair_count FROM lineitem
""")
def pair_counts(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return profiling.pair_counts(rows, "l_quantity", "l_discount")


@query("density", """
    WITH s AS (
        SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * power(count(*), -0.2) AS h
        FROM events GROUP BY event_type),
    g AS (SELECT *, i AS point, lo + i * (hi - lo) / 49 AS x FROM s CROSS JOIN range(50) r(i))
    SELECT g.event_type, CAST(point AS INTEGER) AS point, round(x, 6) AS grid_x,
        round(sum(exp(-0.5 * power((x - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
    FROM g JOIN events e USING (event_type) GROUP BY ALL
""")
def density(spark, sf):
    d = profiling.density(read_table(spark, sf, "events"), "event_type", "value")
    return d.select("event_type", "point", F.round("grid_x", 6).alias("grid_x"), F.round("density", 8).alias("density"))


def sql_profile(table: str, numbers: list[str], others: list[str]) -> str:
    shared = "round(count(*) FILTER (WHERE {0} IS NULL) / count(*) * 100, 2) AS null_percent, count({0}) AS filled"
    parts = [f"""SELECT '{c}' AS column_name, {shared.format(c)}, CAST(NULL AS BIGINT) AS distinct_values,
        round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
        round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
        round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, CAST(max({c}) AS DOUBLE) AS max, count(*) AS rows FROM {table}""" for c in numbers]
    parts += [f"""SELECT '{c}', {shared.format(c)}, count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM {table}""" for c in others]
    keys = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in numbers + others)
    return f"""SELECT *, (SELECT CAST(count(*) - count(DISTINCT ({keys})) AS BIGINT) FROM {table}) AS duplicate_rows
        FROM ({" UNION ALL ".join(parts)})"""


@query("profile_table", sql_profile(
    "(SELECT * REPLACE (nullif(l_returnflag, 'N') AS l_returnflag, nullif(l_linenumber, 7) AS l_linenumber) FROM lineitem)",
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    ["l_returnflag", "l_linestatus", "l_shipdate"]))
def profile_table(spark, sf):
    rows = read_table(spark, sf, "lineitem").withColumns({
        "l_returnflag": F.nullif("l_returnflag", F.lit("N")), "l_linenumber": F.nullif("l_linenumber", F.lit(7))})
    p = profiling.table_profile(rows)
    return p.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q1", "median", "q3")})


@query("box_stats_seconds", """
    WITH e AS (SELECT event_type, CASE WHEN event_id % 97 = 0 THEN 'infinity'::DOUBLE ELSE epoch(ts) END AS x FROM events),
    f AS (SELECT * FROM e WHERE isfinite(x)),
    q AS (SELECT event_type, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM f GROUP BY 1)
    SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n, min(x) AS lowest, max(x) AS highest,
        min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) AS whisker_low, max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
        count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM f JOIN q USING (event_type) GROUP BY ALL
""")
def box_stats_seconds(spark, sf):
    x = F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    b = profiling.box_stats(read_table(spark, sf, "events").select("event_type", x.alias("x")), "event_type", "x")
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("sorted_nulls_last", """
    SELECT o_orderkey, amount, row_number() OVER (ORDER BY amount DESC NULLS LAST, o_orderkey) AS place
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE floor(o_totalprice) END AS amount FROM orders)
""")
def sorted_nulls_last(spark, sf):
    amount = F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice").cast("double"))
    rows = read_table(spark, sf, "orders").select("o_orderkey", amount.alias("amount"))
    return profiling.placed(rows, "amount", "o_orderkey")


@query("datepart_counts_year", """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS part, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM lineitem GROUP BY 1
""")
def datepart_counts_year(spark, sf):
    return profiling.datepart_counts(read_table(spark, sf, "lineitem"), "l_shipdate", "year")


@query("datepart_counts_day", """
    SELECT CAST(day(l_shipdate) AS INTEGER) AS part, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM lineitem GROUP BY 1
""")
def datepart_counts_day(spark, sf):
    return profiling.datepart_counts(read_table(spark, sf, "lineitem"), "l_shipdate", "day")


@query("schema_conformance", """
    SELECT unnest(['quantity in range', 'percent in steps', 'status known']) AS rule, count(*) AS checked,
        unnest([count(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 40)),
                count(*) FILTER (WHERE NOT (round(l_discount * 100) % 10 = 0)),
                count(*) FILTER (WHERE l_linestatus NOT IN ('O'))]) AS violations
    FROM lineitem
""")
def schema_conformance(spark, sf):
    rows = read_table(spark, sf, "lineitem")
    fails = [x for x in conformance.schema_differences(rows, {"l_orderkey": "long", "l_quantity": "double", "l_returnflag": "str"}) if x[3]]
    if fails:
        raise ValueError(f"schema mismatch: {fails}")
    percent = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    return conformance.rule_violations(rows, {
        "quantity in range": F.col("l_quantity").between(1, 40),
        "percent in steps": conformance.percent_in_steps(percent),
        "status known": F.col("l_linestatus").isin("O")})
