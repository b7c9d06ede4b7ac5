"""One search request against the whole candidate table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import filters, geo, text


@dataclass(frozen=True)
class Request:
    """What a recruiter asks for. Zero, empty and None switch a criterion off."""

    location: str = ""
    max_distance: float = 20
    max_age: int = 0
    max_ral: int = 0
    date_available: date | None = None
    turno_preferenza: tuple[str, ...] = ()
    parttime_preferenza_perc: int = 0
    skills_mand: str = ""
    certifications_mand: str = ""
    languages_mand: tuple[str, ...] = ()
    education_mand: str = ""
    provinces: tuple[str, ...] = tuple(vocab.SERVED_PROVINCES)


def in_provinces(df: DataFrame, provinces: tuple[str, ...]) -> DataFrame:
    wanted = [p.strip().lower() for p in provinces]
    return df.where(text.place_name(F.col("province_ext")).isin(wanted)) if wanted else df


def _city(cities: DataFrame, name: str) -> Column:
    """The named city as a one-row scalar subquery; null when unknown."""
    return (
        cities.where(text.place_name(F.col("city_name")) == name.strip().lower())
        .agg(F.min_by(F.struct("latitude", "longitude", "region"), F.col("unique_identifier")).alias("city"))
        .scalar()
    )


def place_clauses(df: DataFrame, request: Request, cities: DataFrame) -> tuple[DataFrame, Column]:
    """distance_km, and the OR of distance or city, region, international, national."""
    abroad = F.col("desired_location") == "Internazionale"
    nationwide = (F.lower("country") == "italia") & (F.col("desired_location") == "Nazionale")
    clauses = [abroad, nationwide]
    if request.location.strip():
        df = df.withColumn("_city", _city(cities, request.location))
        lat, lon, region = (F.col(f"_city.{c}") for c in ("latitude", "longitude", "region"))
        placed = geo.is_number(lat) & geo.is_number(lon)
        km = geo.haversine(lat, lon, F.col("latitude"), F.col("longitude"))
        df = df.withColumn("distance_km", F.when(placed, km).otherwise(F.lit(float(vocab.FAR_AWAY_KM))))
        same_city = text.place_name(F.col("location")) == request.location.strip().lower()
        near = F.when(F.coalesce(placed, F.lit(False)), F.col("distance_km") <= request.max_distance).otherwise(same_city)
        home = text.place_name(region)
        same_region = (text.place_name(F.col("region")) == home) & (home != "")
        clauses += [near, same_region & (F.col("desired_location") == "Regionale")]
    return df, filters.any_of(clauses)


def attribute_clauses(request: Request) -> list[Column]:
    """Every criterion that does not depend on the place."""
    clauses = []
    if request.max_age:
        clauses.append(filters.at_most(F.col("age"), F.lit(request.max_age)))
    if request.max_ral:
        clauses.append(filters.at_most(F.col("salary_low"), F.lit(request.max_ral)))
    if request.date_available:
        clauses.append(filters.at_most(F.col("date_available"), F.lit(request.date_available)))
    if request.parttime_preferenza_perc:
        clauses.append(filters.at_least_or_unset(
            F.col("parttime_preferenza_perc"), F.lit(request.parttime_preferenza_perc)))
    if request.turno_preferenza:
        wanted = F.array(*[F.lit(s) for s in request.turno_preferenza])
        clauses.append(filters.holds_all(F.col("turno_preferenza"), wanted))
    for column, terms in (
        ("skills", request.skills_mand.split(",")),
        ("certifications", request.certifications_mand.split(",")),
        ("languages", request.languages_mand),
    ):
        terms = [t.strip().lower() for t in terms if t.strip()]
        if terms:
            clauses.append(filters.mentions_all(F.col(column), F.array(*[F.lit(t) for t in terms])))
    if request.education_mand:
        needed = vocab.EDUCATION_LEVELS.index(request.education_mand) + 1
        clauses.append(filters.level_rank(F.col("education"), vocab.EDUCATION_LEVELS) >= needed)
    return clauses


def filter_candidates(candidates: DataFrame, request: Request, cities: DataFrame) -> DataFrame:
    """Candidates a request admits. The cheap attribute tests come first, so they
    reach the scan; the place is one scalar subquery, not a join."""
    rows = in_provinces(candidates, request.provinces)
    clauses = attribute_clauses(request)
    if clauses:
        rows = rows.where(filters.all_of(clauses))
    rows, place = place_clauses(rows, request, cities)
    return rows.where(place).drop("_city")
