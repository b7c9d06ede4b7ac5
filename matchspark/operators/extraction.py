"""Model answers as columns, behind a provider; rule-based providers need no model.

A provider maps a prompt column to an answer column. It may be plain expressions,
as the rule extractors here, or a Pandas UDF that calls a hosted model (batch_provider).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import geo, jsonx, text, vectors
from matchspark.functions.once import let, where_computed
from matchspark.operators.features import append_shift
from matchspark.operators.skew import join_weighted, small

Provider = Callable[[Column], Column]


def ask(df: DataFrame, prompt: Column, provider: Provider, out: str, dedupe: bool = False) -> DataFrame:
    """Answer column for a prompt expression; null prompts get null.

    Texts of people are mostly distinct and are asked where they lie, without a
    shuffle. With dedupe equal prompts are asked once and the answers joined back,
    which pays when a model call costs more than moving the text.
    """
    if not dedupe:
        return df.withColumn(out, F.when(prompt.isNotNull(), provider(prompt)))
    # Only a hash travels with the wide rows; the texts are moved once per distinct prompt.
    key = lambda c: F.sha2(c, 256)
    prompts = (
        where_computed(df, "prompt_text", prompt, lambda p: p.isNotNull())
        .groupBy("prompt_text").agg(F.count("*").alias("_asked"))
        .select(key(F.col("prompt_text")).alias("prompt_key"), "prompt_text", "_asked")
    )
    answer = lambda part: part.select("prompt_key", provider(F.col("prompt_text")).alias(out))
    keyed = df.withColumn("prompt_key", key(prompt))
    answered = join_weighted(
        keyed.where(F.col("prompt_key").isNotNull()), prompts, ["prompt_key"], "_asked", finish=answer)
    silent = keyed.where(F.col("prompt_key").isNull()).withColumn(out, F.lit(None).cast("string"))
    return answered.drop("prompt_key").unionByName(silent.drop("prompt_key"))


def batch_provider(answer: Callable[[list[str]], list[str]]) -> Provider:
    """Provider from a function on lists of prompts, run on Arrow batches in the executors.

    Marked as not deterministic, so that no plan rewrite calls the model twice. Write
    the answers to a table before a global sort, which reads its input twice.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            answers = pd.Series([None] * len(prompts), dtype=object)
            asked = prompts.notna().to_numpy()
            if asked.any():
                answers[asked] = answer(prompts[asked].tolist())
            yield answers

    return run.asNondeterministic()


@dataclass(frozen=True)
class Vocabulary:
    """Word lists the rule extractor looks for; parameters, so any language fits."""

    regions: Sequence[str] = tuple(vocab.REGIONS)
    languages: Sequence[str] = tuple(vocab.LANGUAGES)
    education: Sequence[str] = tuple(vocab.EDUCATION_LEVELS)
    shifts: Sequence[str] = tuple(vocab.SHIFTS)
    percents: Sequence[int] = tuple(vocab.PART_TIME_PERCENTS)
    skills: Sequence[str] = ()
    soft_skills: Sequence[str] = ()
    certifications: Sequence[str] = ()
    labels: dict = field(default_factory=lambda: {
        "location": "domicilio", "country": "nazione", "last_job": "ultimo lavoro",
        "second_last_job": "penultimo lavoro", "third_last_job": "terzultimo lavoro",
    })


def _mentioned(c: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.lit("")
    found = let(F.lower(c), lambda low: F.filter(
        F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, F.lower(w))))
    return F.array_join(found, ", ")


def _first_mentioned(c: Column, words: Sequence[str]) -> Column:
    return let(F.lower(c), lambda low: F.coalesce(
        *[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words], F.lit("")))


def _after_label(c: Column, label: str) -> Column:
    """Value after 'label:' up to a separator."""
    return F.trim(F.regexp_extract(c, rf"(?i)(?:^|[^a-z]){label}: *([^|;\n]*)", 1))


def candidate_rules(words: Vocabulary = Vocabulary()) -> Provider:
    """A JSON answer with the fourteen candidate fields, from labels and word lists."""

    def rule(c: Column) -> Column:
        found = {
            "age": F.regexp_extract(c, r"(?i)\b(?:eta|età|age): *([0-9]{1,3})\b", 1),
            "date_of_birth": F.regexp_extract(c, r"\b((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})\b", 1),
            "zip_code": F.regexp_extract(c, r"(?i)\bcap:? *([0-9]{5})\b", 1),
            "region": _first_mentioned(c, words.regions),
            "skills": _mentioned(c, words.skills),
            "soft_skills": _mentioned(c, words.soft_skills),
            "languages": _mentioned(c, words.languages),
            "certifications": _mentioned(c, words.certifications),
            "education": _first_mentioned(c, list(reversed(words.education))),
            **{name: _after_label(c, label) for name, label in words.labels.items()},
        }
        return F.to_json(F.struct(*[found[n].alias(n) for n in vocab.CANDIDATE_FEATURES]))

    return rule


def vacancy_rules(words: Vocabulary = Vocabulary()) -> Provider:
    """A JSON answer with the seven vacancy fields; country and percentage have defaults."""

    def rule(c: Column) -> Column:
        hours = F.regexp_extract(c, r"(?i)\b([0-9]{1,2}) *(?:h|ore)\b", 1).try_cast("int")
        stated = F.regexp_extract(c, r"\b([0-9]{1,3}) *%", 1).try_cast("int")
        country = _after_label(c, "nazione")
        found = {
            "country": F.when(country == "", F.lit("Italia")).otherwise(country),
            "turno_preferenza": F.when(
                F.contains(F.lower(c), F.lit("full time giornaliero")), F.lit("Mattina, Pomeriggio")
            ).otherwise(_mentioned(c, words.shifts)),
            "parttime_preferenza_perc": F.coalesce(
                stated, F.round(hours * 100 / 40).cast("int"), F.lit(100)).cast("string"),
            "skills": _mentioned(c, words.skills),
            "languages": _mentioned(c, words.languages),
            "education": _first_mentioned(c, list(reversed(words.education))),
            "certifications": _mentioned(c, words.certifications),
        }
        return F.to_json(F.struct(*[found[n].alias(n) for n in vocab.VACANCY_FEATURES]))

    return rule


def weekend_rule(c: Column) -> Column:
    """True when the reply after the question says yes."""
    reply = F.lower(F.substring_index(c, "?", -1))
    return F.when(reply.rlike(r"(?:^|[^\p{L}])(si|sì|yes|ok|certo|disponibile)(?:[^\p{L}]|$)")
                  & ~reply.rlike(r"(?:^|[^\p{L}])(no|non)(?:[^\p{L}]|$)"), F.lit("True")).otherwise(F.lit("False"))


Stage = Callable[[DataFrame], DataFrame]


def extract(df: DataFrame, source: str, provider: Provider, names: Sequence[str], rules: dict,
            stage: Stage = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(rows with validated feature columns, rejected rows with the unusable answer).

    stage may write the answered rows and read them back: both results then come from
    the same answers and the model is asked once.
    """
    asked = stage(ask(df, F.col(source), provider, "answer"))
    repaired = jsonx.repair_json(F.col("answer"))
    kept = where_computed(asked, "_json", jsonx.parse_json(repaired), lambda j: j.isNotNull())
    base = [F.col(c) for c in df.columns if c not in names]
    features = kept.select(*base, *jsonx.fields(F.col("_json"), names)).select(
        *base, *jsonx.validated(names, rules))
    rejected = where_computed(asked, "answer", repaired, lambda a: F.try_parse_json(a).isNull())
    return features, rejected


def extract_candidates(df: DataFrame, provider: Provider | None = None, source: str = "description", stage: Stage = lambda rows: rows):
    return extract(df, source, provider or candidate_rules(),
                   vocab.CANDIDATE_FEATURES, jsonx.CANDIDATE_RULES, stage)


def extract_vacancies(df: DataFrame, provider: Provider | None = None, source: str = "description", stage: Stage = lambda rows: rows):
    return extract(df, source, provider or vacancy_rules(),
                   vocab.VACANCY_FEATURES, jsonx.VACANCY_RULES, stage)


def embed(df: DataFrame, columns: dict[str, str], dims: int = 1024,
          embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Vector columns {vector: text}; earlier vectors are dropped first."""
    make = embedder or (lambda c: vectors.hash_embedding(c, dims))
    kept = df.select([c for c in df.columns if not c.lower().endswith("_emb")])
    return kept.withColumns({out: make(F.col(source)) for out, source in columns.items()})


def ask_weekend(df: DataFrame, provider: Provider | None = None, flag: str | None = None) -> DataFrame:
    """Weekend answer for people with a chat (and the flag, when given); nobody else is
    asked, and they count as 'False'."""
    wanted = text.not_blank(F.col("chatwa"))
    if flag:
        wanted = wanted & F.coalesce(F.col(flag), F.lit(False))
    chat = F.when(wanted, F.col("chatwa"))
    answered = ask(df, chat, provider or weekend_rule, "weekend")
    return answered.withColumn("weekend", F.coalesce("weekend", F.lit("False")))


def update_weekend_shift(df: DataFrame, provider: Provider | None = None, flag: str | None = None) -> DataFrame:
    """One pass over all rows: rows that are not asked keep their shifts."""
    answered = ask_weekend(df, provider, flag)
    return answered.withColumn(
        "turno_preferenza", append_shift(F.col("turno_preferenza"), F.col("weekend"))).drop("weekend")


def repair_coordinates(cities: DataFrame, known: DataFrame) -> DataFrame:
    """Cities with missing or malformed coordinates get them from a frame of known
    ones (city_name, province_ext, latitude, longitude), kept only when well formed."""
    good = geo.well_formed(F.col("latitude")) & geo.well_formed(F.col("longitude"))
    fixes = (
        known.groupBy(F.lower(F.trim("city_name")).alias("_city"), F.lower(F.trim("province_ext")).alias("_prov"))
        .agg(F.min(F.struct("latitude", "longitude")).alias("_fix"))
    )
    broken = (
        cities.where(~good)
        .withColumns({"_city": F.lower(F.trim("city_name")), "_prov": F.lower(F.trim("province_ext"))})
        .join(small(fixes), ["_city", "_prov"], "left")
    )
    repaired = broken.select(*[
        F.when(geo.well_formed(F.col(f"_fix.{c}")), F.col(f"_fix.{c}")).cast(cities.schema[c].dataType).alias(c)
        if c in ("latitude", "longitude") else F.col(c)
        for c in cities.columns
    ])
    return cities.where(good).unionByName(repaired)
