"""Expressions for JSON written by a model, and for the fields inside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions.text import BLANK, strip, valid_text


def repair_json(c: Column) -> Column:
    """Fences, line breaks, backslashes and a stray closing quote removed; null becomes ''."""
    text = F.regexp_replace(F.lower(c), f"^{BLANK}*+```json{BLANK}*+", "")
    text = F.regexp_replace(text, r"\\", "")
    text = strip(F.regexp_replace(text, f"{BLANK}++", " "))
    text = F.regexp_replace(text, f"{BLANK}*+```$", "")
    text = F.regexp_replace(text, f"{BLANK}*+['\"]$", "")
    return F.coalesce(text, F.lit(""))


def parse_json(c: Column) -> Column:
    return F.try_parse_json(c)


def is_valid_json(c: Column) -> Column:
    return (c != "") & F.try_parse_json(c).isNotNull()


def fields(variant: Column, names: Sequence[str]) -> list[Column]:
    """Each key as a string; absent keys are null."""
    return [F.try_variant_get(variant, f"$.{n}", "string").alias(n) for n in names]


def has_keys(c: Column, names: Sequence[str]) -> Column:
    """The text mentions every key."""
    keys = F.array(*[F.lit(n) for n in names])
    return F.coalesce(F.forall(keys, lambda k: F.contains(c, k)), F.lit(False))


def valid_zip(c: Column) -> Column:
    return F.when(c.rlike(vocab.ZIP_PATTERN), c)


def valid_int(c: Column, low: int, high: int) -> Column:
    # The pattern first: a failed cast raises and catches inside, which is slow on dirty columns.
    value = F.when(F.trim(c.cast("string")).rlike("^[+-]?[0-9]{1,9}$"), F.trim(c.cast("string")).cast("int"))
    return F.when(value.between(low, high), value)


def valid_age(c: Column) -> Column:
    return valid_int(c, 1, 150)


def valid_birth_date(c: Column) -> Column:
    """ISO dates with real month lengths; 29 February is refused."""
    return F.when(c.rlike(vocab.BIRTH_PATTERN), F.try_to_date(c, "yyyy-MM-dd"))


CANDIDATE_RULES = {
    "zip_code": valid_zip, "age": valid_age, "date_of_birth": valid_birth_date,
}
VACANCY_RULES = {"parttime_preferenza_perc": lambda c: valid_int(c, 0, 100)}


def validated(names: Sequence[str], rules: dict) -> list[Column]:
    return [rules.get(n, valid_text)(F.col(n)).alias(n) for n in names]
