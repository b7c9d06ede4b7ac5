"""Activity dates and the filters on them. Time is always the argument as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_start(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def last_change(changes: DataFrame, key: str, ts: str, as_of: Column, days: int) -> DataFrame:
    """Latest status change per key inside the window."""
    return (
        changes.where(F.col(ts) >= window_start(as_of, days))
        .groupBy(key)
        .agg(F.max(ts).alias("last_status_change"))
    )


def last_active(*dates: Column) -> Column:
    """Latest of the known dates; null only when all are unknown."""
    return F.greatest(*dates) if len(dates) > 1 else dates[0]


def recent(
    entities: DataFrame, changes: DataFrame, key: str, changes_ts: str,
    own_dates: list[str], as_of: Column, days: int, changes_key: str | None = None,
) -> DataFrame:
    """Rows touched inside the window, by their own dates or by a status change."""
    latest = last_change(changes, changes_key or key, changes_ts, as_of, days)
    if changes_key and changes_key != key:
        latest = latest.withColumnRenamed(changes_key, key)
    start = window_start(as_of, days)
    fresh = F.col("last_status_change").isNotNull()
    for name in own_dates:
        fresh = fresh | (F.col(name) >= start)
    return (
        entities.join(latest, key, "left")
        .where(fresh)
        .withColumn("date_last_active",
                    last_active(*[F.col(n) for n in own_dates], F.col("last_status_change")))
        .drop("last_status_change")
    )


def between_dates(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    return df.where(F.col(ts).between(start, end))


def retain(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) >= window_start(as_of, days))


def since_high_water(df: DataFrame, processed: DataFrame | None, ts: str) -> DataFrame:
    """Rows at or after the newest processed date; all rows when nothing was processed."""
    if processed is None:
        return df
    newest = processed.agg(
        F.coalesce(F.max(ts), F.lit("1900-01-01").cast(df.schema[ts].dataType)).alias("newest"))
    return df.where(F.col(ts) >= newest.scalar())
