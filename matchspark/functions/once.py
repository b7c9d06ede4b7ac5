"""Evaluating an expensive expression once.

A predicate on a computed column is pushed below the projection and computed a
second time there, and an expression used twice in a CASE is two trees. Both
double the cost of regular expressions on long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def where_computed(df: DataFrame, name: str, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows whose computed value passes, with the value as a column, computed once."""
    return df.withColumn(name, F.explode(F.filter(F.array(value), keep)))
