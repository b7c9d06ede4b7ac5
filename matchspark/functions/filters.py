"""Predicates: null-tolerant bounds, contains-all, and structured filter objects."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(clauses: Iterable[Column]) -> Column:
    """OR of clauses; no clause means no match. Null counts as false."""
    return reduce(operator.or_, (F.coalesce(c, F.lit(False)) for c in clauses), F.lit(False))


def all_of(clauses: Iterable[Column]) -> Column:
    return reduce(operator.and_, (F.coalesce(c, F.lit(False)) for c in clauses), F.lit(True))


def at_most(c: Column, bound: Column) -> Column:
    return c.isNull() | (c <= bound)


def at_least_or_unset(c: Column, bound: Column) -> Column:
    return c.isNull() | (c == 0) | (c >= bound)


def mentions_all(c: Column, terms: Column) -> Column:
    """The text contains every term of an array, ignoring case."""
    return F.coalesce(
        F.forall(terms, lambda t: F.contains(F.lower(c), F.lower(F.trim(t)))), F.lit(False))


def holds_all(have: Column, wanted: Column) -> Column:
    """The list holds every wanted member; a null or empty list passes."""
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    return have.isNull() | (F.size(have) == 0) | (F.size(F.array_except(low(wanted), low(have))) == 0)


def level_rank(c: Column, levels: list[str]) -> Column:
    """Position of a level in its ordered list, from 1; null when unknown."""
    ranks = F.array(*[F.lit(x.lower()) for x in levels])
    position = F.array_position(ranks, F.lower(F.trim(c)))
    return F.when(position > 0, position)


_COMPARE = {
    "@eq": operator.eq, "@lte": operator.le, "@gte": operator.ge,
    "@contains": lambda c, v: F.array_contains(c, v),
}


def compile_filter(obj: dict) -> Column:
    """Turn {'@and': [{'@lte': {'age': 40}}, …]} into a predicate; {} keeps every row."""
    clauses = []
    for op, body in obj.items():
        if op == "@and":
            clauses.append(all_of(compile_filter(x) for x in body))
        elif op == "@or":
            clauses.append(any_of(compile_filter(x) for x in body))
        elif op == "@not":
            clauses.append(~F.coalesce(compile_filter(body), F.lit(False)))
        elif op in _COMPARE:
            clauses.extend(_COMPARE[op](F.col(name), F.lit(value)) for name, value in body.items())
        else:
            raise ValueError(f"unknown filter operator {op}")
    return all_of(clauses)
