"""Schema and format checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema_differences(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str, bool]]:
    """Rows (column, finding, detail, fails): missing and mistyped columns fail, extra ones do not.
    A type matches when its expected name is part of the actual one."""
    actual = {f.name.lower(): f.dataType.typeName().lower() for f in df.schema}
    wanted = {k.lower(): v.lower() for k, v in expected.items()}
    found = [(c, "missing", wanted[c], True) for c in sorted(wanted.keys() - actual.keys())]
    found += [(c, "extra", actual[c], False) for c in sorted(actual.keys() - wanted.keys())]
    found += [(c, "type", f"{actual[c]} is not {wanted[c]}", True)
              for c in sorted(wanted.keys() & actual.keys()) if wanted[c] not in actual[c]]
    return found


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, checked, violations) for boolean rules, all in one pass. Null counts as kept."""
    counted = df.agg(
        F.count("*").alias("checked"),
        *[F.count_if(~F.coalesce(rule, F.lit(True))).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)])
    return counted.select("checked", F.explode(rows).alias("r")).select("r.rule", "checked", "r.violations")


def salary_in_range(c: Column) -> Column:
    return c.between(1, 1_000_000)


def percent_in_steps(c: Column) -> Column:
    value = F.regexp_replace(c.cast("string"), "%", "").try_cast("int")
    return F.when(c.isNotNull(), F.coalesce(value.between(0, 100) & (value % 10 == 0), F.lit(False)))
