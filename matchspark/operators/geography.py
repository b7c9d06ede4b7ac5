"""City dimension joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import geo, text
from matchspark.operators.skew import small


def known_zip(people: DataFrame, cities: DataFrame) -> DataFrame:
    """Zip codes not in the dimension become null. The zip list stays on the executors."""
    zips = cities.select(F.col("zip").alias("zip_code")).where("zip_code is not null").distinct()
    return (
        people.join(small(zips.withColumn("_known", F.lit(True))), "zip_code", "left")
        .withColumn("zip_code", F.when(F.col("_known"), F.col("zip_code")))
        .select(people.columns)
    )


def one_per_name(cities: DataFrame) -> DataFrame:
    """One city per lower-case name: the smallest identifier."""
    rest = [c for c in ("zip", "latitude", "longitude", "province_ext", "region") if c in cities.columns]
    return (
        cities.groupBy(F.lower("city_name").alias("_city"))
        .agg(F.min_by(F.struct(*rest), F.col("unique_identifier")).alias("_geo"))
        .select("_city", *[F.col(f"_geo.{c}").alias(f"_{c}") for c in rest])
    )


def enrich(people: DataFrame, cities: DataFrame, fan_out: bool = False) -> DataFrame:
    """Zip, coordinates and province from the city of residence.

    fan_out keeps one row per matching city when a name occurs more than once.
    """
    base = people.select([c for c in people.columns if c not in vocab.GEO_COLUMNS])
    if fan_out:
        dimension = cities.select(
            F.lower("city_name").alias("_city"),
            *[F.col(c).alias(f"_{c}") for c in ("zip", "latitude", "longitude", "province_ext")])
    else:
        dimension = one_per_name(cities)
    joined = known_zip(base, cities).withColumn("_city", F.lower("location")).join(
        small(dimension), "_city", "left")
    return joined.select(
        *[F.coalesce("zip_code", "_zip").alias("zip_code") if c == "zip_code" else F.col(c) for c in base.columns],
        geo.valid_latitude(F.col("_latitude")).alias("latitude"),
        geo.valid_longitude(F.col("_longitude")).alias("longitude"),
        text.valid_text(F.col("_province_ext")).alias("province_ext"),
        F.lit(vocab.FAR_AWAY_KM).alias("distance_km"),
    )
