"""Change detection against the previous output, and reprocessing of changed rows only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions.text import not_blank
from matchspark.sources.tables import align


def fingerprint(c: Column) -> Column:
    """Stands for a text in a join: 64 characters travel instead of the text."""
    return F.sha2(c, 256)


def changed(raw: Column, old_print: Column, old_is_header: Column) -> Column:
    """New or different text, never null. A stored header literal is never reprocessed."""
    differs = (fingerprint(raw) != old_print) & ~old_is_header
    return F.coalesce(old_print.isNull() | differs, F.lit(True))


def changed_chat(chat: Column, raw: Column, old_print: Column, old_is_header: Column) -> Column:
    differs = (fingerprint(raw) != old_print) & ~old_is_header
    return F.coalesce(chat.isNotNull() & (old_print.isNull() | differs), F.lit(False))


def with_history(new: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Left join to the previous output: columns of both sides get the suffix _old
    on the previous side, columns only it has carry over."""
    renamed = previous.select(
        F.col(key),
        *[F.col(c).alias(f"{c}_old" if c in new.columns else c) for c in previous.columns if c != key])
    return new.join(renamed, key, "left")


def _history(previous: DataFrame, texts: dict[str, str]) -> DataFrame:
    """The previous output with compared texts as fingerprints and header marks."""
    return previous.withColumns({
        **{f"{c}_is_header": F.col(c) == header for c, header in texts.items()},
        **{c: fingerprint(F.col(c)) for c in texts},
    })


def detect_candidates(new: DataFrame, previous: DataFrame | None, key: str = "candidateid") -> DataFrame:
    """Current candidates with what carries over from the last run, and the flags
    needs_processing (new or changed text) and needs_processing_wa (changed chat)."""
    rows = new.where(not_blank(F.col("description")))
    if previous is None:
        return rows.withColumns({
            "needs_processing": F.lit(True),
            "needs_processing_wa": F.col("chatwa").isNotNull(),
            "time_processing": F.lit(None).cast("timestamp_ntz"),
        })
    kept = previous.drop("needs_processing", "needs_processing_wa")
    history = _history(kept, {"description_raw": vocab.RAW_HEADER, "chatwa_raw": vocab.CHAT_HEADER})
    joined = with_history(rows, history, key).withColumns({
        "needs_processing": changed(
            F.col("description_raw"), F.col("description_raw_old"), F.col("description_raw_is_header")),
        "needs_processing_wa": changed_chat(
            F.col("chatwa"), F.col("chatwa_raw"), F.col("chatwa_raw_old"), F.col("chatwa_raw_is_header")),
    })
    # An earlier weekend answer stays while the chat behind it has not changed.
    weekend = F.lit(vocab.WEEKEND_SHIFT)
    shifts = F.coalesce("turno_preferenza", F.array().cast("array<string>"))
    keeps = (
        ~F.col("needs_processing_wa") & F.col("chatwa").isNotNull()
        & F.coalesce(F.array_contains("turno_preferenza_old", weekend), F.lit(False))
        & ~F.array_contains(shifts, weekend))
    return joined.withColumn(
        "turno_preferenza", F.when(keeps, F.array_append(shifts, weekend)).otherwise(F.col("turno_preferenza")),
    ).drop("description_raw_is_header", "chatwa_raw_is_header")


def detect_vacancies(new: DataFrame, previous: DataFrame | None, key: str = "joborderid") -> DataFrame:
    rows = new.where(not_blank(F.col("description")) | not_blank(F.col("jobtitle")))
    if previous is None:
        return rows.withColumns({
            "needs_processing": F.lit(True), "time_processing": F.lit(None).cast("timestamp_ntz")})
    history = _history(previous.drop("needs_processing"), {"description_raw": vocab.RAW_HEADER})
    return with_history(rows, history, key).withColumn("needs_processing", changed(
        F.col("description_raw"), F.col("description_raw_old"), F.col("description_raw_is_header"),
    )).drop("description_raw_is_header")


def split(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    on = F.coalesce(F.col(flag), F.lit(False))
    return df.where(on), df.where(~on)


def reprocess(
    df: DataFrame, flag: str, recompute: Callable[[DataFrame], DataFrame], drop: list[str], stamp: Column,
) -> DataFrame:
    """Apply recompute to flagged rows, stamp them, and union the others unchanged.

    Columns ending in _old and the old feature columns of flagged rows go first;
    the others are cast to the recomputed schema.
    """
    current = df.select([c for c in df.columns if not c.endswith("_old")])
    todo, done = split(current, flag)
    fresh = recompute(todo.drop(*drop)).withColumn("time_processing", stamp)
    return fresh.unionByName(align(done, fresh.schema))


def run_counts(df: DataFrame, processed_at: Column, **flags: str) -> DataFrame:
    """One row of counts for the run log, from one pass."""
    return df.agg(
        *[F.count_if(F.col(flag)).alias(name) for name, flag in flags.items()],
        F.max(processed_at).alias("processed_at"),
    )
