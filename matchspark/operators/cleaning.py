"""Cleaning a text column of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions import text
from matchspark.functions.once import where_computed


def clean_description(df: DataFrame, column: str, before: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Collapse spaces, strip HTML, lower-case, keep usable texts.

    Blank texts need no test of their own: they end up as '', which is not usable.
    before is applied to the raw text first.
    """
    cleaned = F.lower(text.strip_html(text.collapse_spaces(before(F.col(column)))))
    return where_computed(df, column, cleaned, text.usable_text)


def clean_texts(
    df: DataFrame, column: str = "description", extra: tuple[str, ...] = (),
    cap: int | None = None, prose_runs: bool = True,
) -> DataFrame:
    """Noise and cleaning; extra columns only lose noise. With a cap, longer texts become ''."""
    denoise = lambda c: text.remove_noise(c, prose_runs)
    capped = (lambda c: c) if cap is None else (lambda c: text.cap_length(c, cap))
    cleaned = clean_description(df, column, denoise)
    return cleaned.withColumns({
        column: capped(F.col(column)), **{name: capped(denoise(F.col(name))) for name in extra},
    })
