"""The jobs end to end: ingestion, transformation, matching."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import jsonx, text
from matchspark.operators import cleaning, cost, extraction, features, geography, incremental, matching, notes, recency
from matchspark.operators.filtering import Request, filter_candidates
from matchspark.sources import tables


def ingest_candidates(candidates: DataFrame, submissions: DataFrame, note_rows: DataFrame, as_of: Column,
                      chat_action: str, question: str = vocab.CHAT_QUESTION, days: int = vocab.CANDIDATE_DAYS) -> DataFrame:
    """Recently active candidates with cleaned text, chat, shifts, mobility and part-time."""
    fresh = recency.recent(
        candidates, submissions, "candidateid", "data_ultimo_cambio_status",
        ["date_added", "date_last_modified"], as_of, days)
    chats = notes.chat_threads(note_rows, chat_action, question)
    joined = notes.with_threads(fresh, chats).withColumns({
        "candidateid": F.col("candidateid").cast("string"),
        "description_raw": F.col("description"),
        "chatwa_raw": F.col("chatwa"),
        "desired_location": features.highest_level(F.col("desired_location"), vocab.MOBILITY_LEVELS),
        "turno_preferenza": text.split_members(F.col("turno_preferenza")),
        "parttime_preferenza_perc": features.largest_percent(
            F.col("parttime_preferenza_perc"), vocab.PART_TIME_PERCENTS),
    })
    return cleaning.clean_texts(joined, "description", ("chatwa",))


def ingest_vacancies(orders: DataFrame, submissions: DataFrame, as_of: Column,
                     days: int = vocab.VACANCY_DAYS) -> DataFrame:
    """Open, recently active vacancies with one assembled, cleaned text."""
    open_orders = orders.where((F.col("isopen") == 1) & (F.col("status") == "Accepting Candidates"))
    fresh = recency.recent(
        open_orders, submissions, "joborderid", "data_ultimo_cambio_status", ["datelastmodified"], as_of, days)
    # Labels of the assembled text.
    parts = [
        ("Skills richieste: ", "skill_list"), ("Percentuale part time: ", "part_time_percent"),
        ("Titoli di studio richiesti: ", "titoli_richiesti"), ("DESCRIZIONE USO INTERNO: ", "descrizione_uso_interno"),
        ("TESTO PUBBLICAZIONE: ", "testo_pubblicazione"), ("RICHIESTE AGGIUNTIVE: ", "richieste_aggiuntive"),
        ("REQUISITI: ", "requisiti"),
    ]
    described = fresh.select(
        "joborderid", "jobtitle", F.col("citta").alias("location"), F.col("regione").alias("region"),
        F.col("salary").alias("salary_low"), F.col("data_inizio_validita").alias("date_available"),
        "date_last_active",
        features.vacancy_text([(label, F.col(c)) for label, c in parts]).alias("description"),
    ).withColumn("description_raw", F.col("description"))
    return cleaning.clean_texts(described)


def enrich_candidates(
    detected: DataFrame, cities: DataFrame, stamp: Column,
    provider: extraction.Provider | None = None, weekend: extraction.Provider | None = None, dims: int = 1024,
    answers: "Answers | None" = None,
) -> DataFrame:
    """Features, vectors and places of changed candidates; weekend shift of changed chats."""
    answers = answers or Answers()

    def recompute(rows: DataFrame) -> DataFrame:
        found, answers.rejected = extraction.extract_candidates(rows, provider, stage=answers.stage)
        # Vectors last: the joins to the cities then move no vectors.
        return extraction.embed(geography.enrich(found, cities), {
            "skills_emb": "skills", "last_job_emb": "last_job",
            "second_last_job_emb": "second_last_job", "third_last_job_emb": "third_last_job"}, dims)

    by_text = incremental.reprocess(
        detected, "needs_processing", recompute,
        vocab.CANDIDATE_FEATURES + vocab.CANDIDATE_VECTORS + vocab.GEO_COLUMNS, stamp)
    # No second split: rows whose chat did not change are simply not asked.
    asked = extraction.update_weekend_shift(by_text, weekend, "needs_processing_wa")
    return asked.withColumn(
        "time_processing", F.when(F.col("needs_processing_wa"), stamp).otherwise(F.col("time_processing")))


def transform_candidates(
    new: DataFrame, previous: DataFrame | None, cities: DataFrame, stamp: Column, **options,
) -> DataFrame:
    return enrich_candidates(incremental.detect_candidates(new, previous), cities, stamp, **options)


def transform_vacancies(new: DataFrame, previous: DataFrame | None, stamp: Column,
                        provider: extraction.Provider | None = None, dims: int = 1024, answers: "Answers | None" = None) -> DataFrame:
    return enrich_vacancies(incremental.detect_vacancies(new, previous), stamp, provider, dims, answers)


def enrich_vacancies(detected: DataFrame, stamp: Column, provider: extraction.Provider | None = None, dims: int = 1024,
                     answers: "Answers | None" = None) -> DataFrame:
    """Features and vectors of changed vacancies."""
    answers = answers or Answers()

    def recompute(rows: DataFrame) -> DataFrame:
        found, answers.rejected = extraction.extract_vacancies(rows, provider, stage=answers.stage)
        return extraction.embed(found, {"skills_emb": "skills", "jobtitle_emb": "jobtitle"}, dims)

    return incremental.reprocess(
        detected, "needs_processing", recompute, vocab.VACANCY_FEATURES + vocab.VACANCY_VECTORS, stamp)


@dataclass
class Answers:
    """Where a run keeps the model's answers, and the rows whose answer was no JSON."""

    stage: Callable[[DataFrame], DataFrame] = lambda rows: rows
    rejected: DataFrame | None = None


def _published(spark: SparkSession, path: str) -> Callable[[DataFrame], DataFrame]:
    def stage(rows: DataFrame) -> DataFrame:
        tables.publish(rows, path)
        return tables.current(spark, path)

    return stage


def _run(
    spark: SparkSession, root: str, name: str, many: str, key: str, detect: Callable[[DataFrame | None], DataFrame],
    enrich: Callable[[DataFrame, Answers], DataFrame], stamp: Column, run_id: str | None, **counted: str,
) -> DataFrame:
    """One run against the table published by the last one, with its rejects and log row.

    The joined rows with their flags are written first, then the answers: what reads them
    later, on a lost executor too, leads neither to the history join nor to the model.
    """
    target = f"{root}/{many}"
    previous = tables.current(spark, target) if tables.table_exists(spark, target) else None
    detected = _published(spark, f"{root}/{many}_detected")(detect(previous))
    answers = Answers(_published(spark, f"{root}/{many}_answered"))
    tables.publish(enrich(detected, answers), target)
    tables.publish(answers.rejected.select(key, "answer"), f"{root}/{name}_rejects")
    rejects = tables.current(spark, f"{root}/{name}_rejects").agg(F.count("*").alias("rejected")).scalar()
    counts = incremental.run_counts(detected, stamp, **counted).withColumn("nproc_rejected", rejects)
    # In the order of starting, also of runs with one stamp.
    tables.append_log(counts, f"{root}/{name}_log", run_id or f"{time.time_ns():020d}-{uuid.uuid4().hex}")
    return tables.current(spark, target)


def run_transformation(
    spark: SparkSession, new: DataFrame, root: str, cities: DataFrame, stamp: Column, run_id: str | None = None, **options,
) -> DataFrame:
    """One candidate run: tables candidates, candidate_rejects and candidate_log under root."""
    return _run(
        spark, root, "candidate", "candidates", "candidateid", lambda previous: incremental.detect_candidates(new, previous),
        lambda rows, answers: enrich_candidates(rows, cities, stamp, answers=answers, **options), stamp, run_id,
        nproc_cv_rows="needs_processing", nproc_wa_rows="needs_processing_wa")


def run_vacancies(
    spark: SparkSession, new: DataFrame, root: str, stamp: Column, run_id: str | None = None, **options,
) -> DataFrame:
    """One vacancy run: tables vacancies, vacancy_rejects and vacancy_log under root."""
    return _run(
        spark, root, "vacancy", "vacancies", "joborderid", lambda previous: incremental.detect_vacancies(new, previous),
        lambda rows, answers: enrich_vacancies(rows, stamp, answers=answers, **options), stamp, run_id,
        nproc_rows="needs_processing")


def requests_from_vacancies(vacancies: DataFrame, cities: DataFrame, max_distance: float = 20.0, provinces: tuple[str, ...] = ()) -> DataFrame:
    """Published openings as rows that matching.match_all takes: coordinates of their city,
    a radius, no mandatory lists but the languages, and the stored vectors."""
    none = F.array().cast("array<string>")
    shifts = F.col("turno_preferenza")
    shifts = text.split_members(shifts) if dict(vacancies.dtypes)["turno_preferenza"] == "string" else shifts
    placed = vacancies.withColumn("_city", text.place_name(F.col("location"))).join(
        geography.one_per_name(cities).select("_city", "_latitude", "_longitude"), "_city", "left")
    return placed.select(
        F.col("joborderid").alias("vacancy_id"), "location", "region", F.col("_latitude").alias("latitude"),
        F.col("_longitude").alias("longitude"), F.lit(float(max_distance)).alias("max_distance"), F.lit(0).alias("max_age"),
        F.lit(0.0).alias("max_ral"), F.col("date_available").cast("date").alias("date_available"),
        F.col("parttime_preferenza_perc").cast("int").alias("parttime_preferenza_perc"), shifts.alias("turno_preferenza"),
        F.lit(None).cast("string").alias("education_mand"), none.alias("skills_mand"),
        F.coalesce(text.split_members(F.col("languages")), none).alias("languages_mand"), none.alias("certifications_mand"),
        F.array(*[F.lit(p) for p in provinces]).cast("array<string>").alias("provinces"), "jobtitle_emb", "skills_emb")


def match_vacancies(vacancies: DataFrame, candidates: DataFrame, cities: DataFrame, k: int = vocab.MATCH_LIMIT, **options) -> DataFrame:
    """Best candidates of every published opening."""
    people = candidates.withColumnRenamed("candidateid", "candidate_id")
    return matching.match_all(requests_from_vacancies(vacancies, cities, **options), people, k)


def cost_study(rows: DataFrame, key: str, source: str, provider: extraction.Provider, names: list[str], n: int = 100) -> DataFrame:
    """A study end to end: a repeatable sample, the answers, whether each is complete JSON,
    its tokens, and the credits of every model."""
    asked = extraction.ask(cost.study_sample(rows, source, key, n), F.col(source), provider, "answer")
    repaired = jsonx.repair_json(F.col("answer"))
    valid = F.coalesce(jsonx.is_valid_json(repaired) & jsonx.has_keys(repaired, names), F.lit(False))
    counted = cost.with_tokens(asked.withColumn("valid", valid), F.col(source), F.col("answer"))
    return cost.cost_by_model(counted, vocab.MODEL_PRICES, "valid")


def search_candidates(candidates: DataFrame, request: Request, request_vectors: DataFrame, cities: DataFrame,
                      k: int = vocab.MATCH_LIMIT, active: dict | None = None) -> DataFrame:
    """One search of the app: filter, score, best k with their display columns."""
    admitted = filter_candidates(candidates, request, cities)
    renamed = admitted.withColumnRenamed("candidateid", "candidate_id")
    ranked = matching.score_request(renamed, request_vectors, k)
    shown = renamed.select([c for c in renamed.columns if not c.endswith("_emb")]).join(ranked, "candidate_id")
    ordered = shown.withColumnRenamed("candidate_id", "candidateid").orderBy(F.col("score").desc(), "candidateid")
    return features.shape_result(ordered, active or {})
