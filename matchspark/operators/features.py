"""Small feature expressions of candidates, vacancies and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import text


def vacancy_text(parts: list[tuple[str, Column]]) -> Column:
    """Labelled parts joined by ' | '; null when every part is blank."""
    known = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for _, c in parts])
    labelled = [F.concat(F.lit(label), F.coalesce(c, F.lit(""))) for label, c in parts]
    return F.when(known.isNotNull(), F.concat_ws(" | ", *labelled))


def highest_level(c: Column, levels: list[str]) -> Column:
    """Highest level named anywhere in the text, ignoring case."""
    return F.coalesce(*[F.when(c.ilike(f"%{x}%"), F.lit(x)) for x in reversed(levels)])


def largest_percent(c: Column, allowed: list[int]) -> Column:
    """Largest allowed percentage named in the text; missing means 100, none named means null."""
    stated, choices = F.coalesce(c, F.lit("100%")), F.array(*[F.lit(v) for v in allowed])
    return F.array_max(F.filter(choices, lambda v: F.contains(stated, v.cast("string"))))


def largest_number(c: Column, default: str = "1000") -> Column:
    """Largest number in the text, compared as numbers."""
    numbers = F.regexp_extract_all(F.coalesce(c, F.lit(default)), F.lit("[0-9]++"), F.lit(0))
    return F.array_max(F.transform(numbers, lambda x: x.try_cast("int")))


def append_shift(shifts: Column, answer: Column, shift: str = vocab.WEEKEND_SHIFT) -> Column:
    """Add the shift when the answer is true and the list (or null) lacks it."""
    known = F.coalesce(shifts, F.array().cast("array<string>"))
    wanted = F.coalesce(F.lower(F.trim(answer)) == "true", F.lit(False)) & ~F.array_contains(known, F.lit(shift))
    return F.when(wanted, F.array_append(known, F.lit(shift))).otherwise(shifts)


def digits_only(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))


def allowed_members(c: Column, allowed: list[str]) -> Column:
    """Allowed values named in a comma list, in the allowed order, ignoring case."""
    given = F.transform(text.split_members(c), lambda x: F.lower(x))
    values = F.array(*[F.lit(a) for a in allowed])
    kept = F.filter(values, lambda a: F.array_contains(given, F.lower(a)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def closest_allowed(c: Column, allowed: list[int]) -> Column:
    """Nearest allowed number, the smaller one on a tie."""
    options = F.array(*[F.struct(F.abs(F.lit(a) - c).alias("far"), F.lit(a).alias("value")) for a in allowed])
    return F.when(c.isNotNull(), F.array_min(options)["value"])


def empty_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def request_from_vacancy(vacancies: DataFrame) -> DataFrame:
    """The search request each vacancy starts from; works on the whole table."""
    return vacancies.select(
        digits_only(F.col("joborderid").cast("string")).cast("long").alias("joborderid"),
        empty_to_null(F.col("jobtitle")).alias("role"),
        empty_to_null(F.col("location")).alias("location"),
        empty_to_null(F.col("region")).alias("region"),
        empty_to_null(F.col("country")).alias("country"),
        F.coalesce("salary_low", F.lit(0)).alias("max_ral"),
        F.col("date_available"),
        allowed_members(F.col("turno_preferenza"), vocab.SHIFTS).alias("turno_preferenza"),
        F.coalesce(closest_allowed(F.col("parttime_preferenza_perc"), vocab.PART_TIME_PERCENTS),
                   F.lit(0)).alias("parttime_preferenza_perc"),
        empty_to_null(F.col("skills")).alias("skills_opt"),
        allowed_members(F.col("languages"), vocab.LANGUAGES).alias("languages_opt"),
        empty_to_null(F.array_join(allowed_members(F.col("education"), vocab.EDUCATION_LEVELS), ", "))
        .alias("education_opt"),
        empty_to_null(F.col("certifications")).alias("certifications_opt"),
    )


# Result columns always shown, columns shown when their filter is
# active, and display names.
RESULT_COLUMNS = [
    "score", "candidateid", "first_name", "last_name", "location", "url", "age",
    "last_job", "second_last_job", "third_last_job",
]
RESULT_IF_ACTIVE = [
    ("skills_mand", "skills"), ("skills_opt", "skills"),
    ("languages_mand", "languages"), ("languages_opt", "languages"),
    ("education_mand", "education"), ("education_opt", "education"),
    ("certifications_mand", "certifications"), ("certifications_opt", "certifications"),
    ("max_ral", "salary_low"), ("date_available", "date_available"),
    ("turno_preferenza", "turno_preferenza"),
    ("parttime_preferenza_perc", "parttime_preferenza_perc"),
]
DISPLAY_NAMES = {
    "score": "Score", "candidateid": "ID Candidato", "first_name": "Nome",
    "last_name": "Cognome", "location": "Location", "url": "URL", "age": "Età",
    "last_job": "Ultima mansione", "second_last_job": "Precedente mansione",
    "third_last_job": "Precedente mansione2", "skills": "Skills",
    "education": "Titolo di Studio", "languages": "Lingue",
    "certifications": "Certificazioni", "salary_low": "RAL",
    "date_available": "Disponibile da", "turno_preferenza": "Preferenza turno",
    "parttime_preferenza_perc": "Preferenza Part time %",
}


def result_columns(active: dict) -> list[str]:
    """Base columns plus those whose request field is set."""
    return list(dict.fromkeys(
        RESULT_COLUMNS + [column for field, column in RESULT_IF_ACTIVE if active.get(field)]))


def shape_result(df: DataFrame, active: dict, url: str = vocab.PROFILE_URL, display: bool = True) -> DataFrame:
    """Profile link, lists as text, wanted columns, display names."""
    shaped = df.withColumn(
        "url", F.concat(F.lit("[Open Link]("), F.lit(url), F.col("candidateid").cast("string"), F.lit(")")))
    if dict(shaped.dtypes).get("turno_preferenza", "").startswith("array"):
        shaped = shaped.withColumn("turno_preferenza", F.array_join("turno_preferenza", ", "))
    shaped = shaped.select([c for c in result_columns(active) if c in shaped.columns])
    return shaped.withColumnsRenamed(DISPLAY_NAMES) if display else shaped
