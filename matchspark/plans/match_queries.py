"""Candidate filters, scores, ratings and synonyms on the driver tables."""

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import filters
from matchspark.operators import matching, rubric, synonyms
from matchspark.operators.filtering import Request, filter_candidates
from matchspark.plans.feature_queries import SQL_CITIES, raw_cities
from matchspark.plans.registry import query
from matchspark.sources.tables import load_cities, lookup, read_table, spread

# Candidates made of the customers: place, mobility, shifts and bounds follow from their columns.
SQL_CANDIDATES = f"""
    SELECT c_custkey AS candidateid, 'City_' || CAST(c_custkey // 25 AS VARCHAR) AS location,
        CASE c_nationkey % 5 WHEN 0 THEN 'Africa' WHEN 1 THEN 'america' ELSE 'ASIA' END AS region,
        CASE WHEN c_nationkey < 20 THEN 'Italia' ELSE 'Francia' END AS country,
        CASE WHEN c_nationkey < 12 THEN 'modena' WHEN c_nationkey < 22 THEN 'BARI' ELSE 'Milano' END AS province_ext,
        CASE c_nationkey % 6 WHEN 0 THEN 'Locale' WHEN 1 THEN 'Regionale' WHEN 2 THEN 'Nazionale' WHEN 3 THEN 'Internazionale' WHEN 4 THEN 'Regionale' END AS desired_location,
        CASE WHEN c_nationkey = 5 THEN NULL ELSE 36 + (c_custkey * 37 % 1100) / 100.0::DOUBLE END AS latitude,
        6 + (c_custkey * 53 % 1250) / 100.0::DOUBLE AS longitude,
        CASE WHEN c_nationkey = 4 THEN NULL ELSE CAST(18 + c_custkey % 50 AS INTEGER) END AS age,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal * 5 END AS salary_low,
        CASE WHEN c_acctbal < 500 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS DATE) END AS date_available,
        CAST(c_custkey % 11 * 10 AS INTEGER) AS parttime_preferenza_perc,
        CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN ['Mattina', 'notte'] WHEN 'FURNITURE' THEN ['Notte']
            WHEN 'HOUSEHOLD' THEN ['Mattina', 'Pomeriggio', 'Notte'] ELSE []::VARCHAR[] END AS turno_preferenza,
        'SQL, ' || c_mktsegment AS skills, CASE WHEN c_acctbal > 3000 THEN 'Inglese, Russo' ELSE 'inglese' END AS languages,
        CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Dottorato/Master' WHEN 2 THEN ' laurea triennale' WHEN 3 THEN 'Laurea specialistica'
            ELSE 'Diploma scuola media' END AS education
    FROM customer"""


def candidates(spark, sf):
    key, nation, funds = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")

    def pick(c, values, otherwise=None):
        out = F.lit(otherwise)
        for match, value in values.items():
            out = F.when(c == match, F.lit(value)).otherwise(out)
        return out

    shifts = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
        .when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("Mattina"), F.lit("notte")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit("Notte")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("Mattina"), F.lit("Pomeriggio"), F.lit("Notte")))
        .otherwise(F.array().cast("array<string>")))
    return read_table(spark, sf, "customer").select(
        key.alias("candidateid"), F.concat(F.lit("City_"), F.floor(key / 25).cast("string")).alias("location"),
        pick(nation % 5, {0: "Africa", 1: "america"}, "ASIA").alias("region"),
        F.when(nation < 20, F.lit("Italia")).otherwise(F.lit("Francia")).alias("country"),
        F.when(nation < 12, F.lit("modena")).when(nation < 22, F.lit("BARI")).otherwise(F.lit("Milano")).alias("province_ext"),
        pick(nation % 6, {0: "Locale", 1: "Regionale", 2: "Nazionale", 3: "Internazionale", 4: "Regionale"}).alias("desired_location"),
        F.when(nation != 5, 36 + (key * 37 % 1100) / 100).alias("latitude"),
        (6 + (key * 53 % 1250) / 100).alias("longitude"),
        F.when(nation != 4, (18 + key % 50).cast("int")).alias("age"),
        F.when(~(funds < 0), funds * 5).alias("salary_low"),
        F.when(~(funds < 500), F.date_add(F.lit("2024-01-01").cast("date"), (key % 300).cast("int"))).alias("date_available"),
        (key % 11 * 10).cast("int").alias("parttime_preferenza_perc"), shifts.alias("turno_preferenza"),
        F.concat(F.lit("SQL, "), "c_mktsegment").alias("skills"),
        F.when(funds > 3000, F.lit("Inglese, Russo")).otherwise(F.lit("inglese")).alias("languages"),
        F.lit("Patente B").alias("certifications"),
        pick(key % 7, {0: None, 1: "Dottorato/Master", 2: " laurea triennale", 3: "Laurea specialistica"},
             "Diploma scuola media").alias("education"))


SQL_HAVERSINE = """2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2)
    + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * power(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2))))"""


@query("candidate_filter", f"""
    WITH c AS ({SQL_CITIES}), p AS ({SQL_CANDIDATES}),
    v AS (SELECT arg_min_null(latitude, unique_identifier) AS latitude, arg_min_null(longitude, unique_identifier) AS longitude,
            arg_min_null(region, unique_identifier) AS region FROM c WHERE lower(city_name) = 'city_1')
    SELECT candidateid, p.location, desired_location, age, round({SQL_HAVERSINE.format(a='v', b='p')}, 6) AS distance_km
    FROM p CROSS JOIN v
    WHERE lower(province_ext) IN ({", ".join("'" + x.lower() + "'" for x in vocab.SERVED_PROVINCES)})
      AND (coalesce({SQL_HAVERSINE.format(a='v', b='p')} <= 400, false)
        OR coalesce(lower(p.region) = lower(trim(v.region)) AND desired_location = 'Regionale', false)
        OR coalesce(desired_location = 'Internazionale', false)
        OR coalesce(lower(country) = 'italia' AND desired_location = 'Nazionale', false))
      AND (age <= 55 OR age IS NULL) AND (salary_low <= 40000 OR salary_low IS NULL)
      AND (date_available <= DATE '2024-09-01' OR date_available IS NULL)
      AND (parttime_preferenza_perc >= 30 OR parttime_preferenza_perc IS NULL OR parttime_preferenza_perc = 0)
      AND (turno_preferenza IS NULL OR len(turno_preferenza) = 0 OR list_has_all(list_transform(turno_preferenza, lambda x: lower(x)), ['mattina', 'notte']))
      AND contains(lower(skills), 'sql') AND contains(lower(languages), 'inglese')
      AND (CASE lower(trim(education)) WHEN 'diploma scuola media' THEN 1 WHEN 'diploma scuola superiore' THEN 2
            WHEN 'laurea triennale' THEN 3 WHEN 'laurea specialistica' THEN 4 WHEN 'dottorato/master' THEN 5 END) >= 1
""")
def candidate_filter(spark, sf):
    request = Request(
        location=" CITY_1", max_distance=400, max_age=55, max_ral=40000, date_available=date(2024, 9, 1),
        turno_preferenza=("Mattina", "Notte"), parttime_preferenza_perc=30, skills_mand="sql", languages_mand=("Inglese",),
        education_mand="Diploma scuola media")
    found = filter_candidates(candidates(spark, sf), request, load_cities(raw_cities(spark, sf)))
    return found.select("candidateid", "location", "desired_location", "age", F.round("distance_km", 6).alias("distance_km"))


@query("shifts_match_all", """
    SELECT p_partkey, p_name FROM part
    WHERE p_size < 10 OR list_has_all(string_split(p_name, ' '), ['red', 'ring'])
""")
def shifts_match_all(spark, sf):
    shifts = F.when(F.col("p_size") < 10, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    parts = read_table(spark, sf, "part").select("p_partkey", "p_name", shifts.alias("shifts"))
    return parts.where(filters.holds_all(F.col("shifts"), F.array(F.lit("Red"), F.lit("ring")))).select("p_partkey", "p_name")


# --- scores: each vector row is a candidate (rotated for its four vectors) and a vacancy ---

SQL_VECTORS = """
    SELECT vec_id, label, embedding::DOUBLE[] AS e1, list_reverse(embedding::DOUBLE[]) AS e2,
        list_concat(embedding[17:64], embedding[1:16])::DOUBLE[] AS e3, list_concat(embedding[33:64], embedding[1:32])::DOUBLE[] AS e4
    FROM embeddings"""


def sql_cosine(a: str, b: str) -> str:
    return (f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-9)")


SQL_SIMS = (f"{sql_cosine('c.e1', 'v.e1')} AS s1, {sql_cosine('c.e2', 'v.e1')} AS s2, "
            f"{sql_cosine('c.e3', 'v.e1')} AS s3, {sql_cosine('c.e4', 'v.e2')} AS s4")


def sql_scaled(weights) -> str:
    return " + ".join(f"{w} * (s{i} - m{i}) / (1 - m{i} + 1e-9)" for i, w in enumerate(weights, 1))


def vector_candidates(spark, sf):
    e = F.col("embedding")
    turn = lambda n: F.concat(F.slice(e, n + 1, 64 - n), F.slice(e, 1, n))
    return spread(read_table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("candidate_id"), F.col("label"), e.alias("last_job_emb"), F.reverse(e).alias("second_last_job_emb"),
        turn(16).alias("third_last_job_emb"), turn(32).alias("skills_emb"))


def vector_vacancies(spark, sf):
    e = F.col("embedding")
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("vacancy_id"), F.col("label"), e.alias("jobtitle_emb"), F.reverse(e).alias("skills_emb"))


@query("vector_score_topk", f"""
    WITH x AS ({SQL_VECTORS}),
    s AS (SELECT c.vec_id AS candidate_id, {SQL_SIMS} FROM x c CROSS JOIN (SELECT * FROM x WHERE vec_id = 7) v),
    m AS (SELECT min(s1) AS m1, min(s2) AS m2, min(s3) AS m3, min(s4) AS m4 FROM s),
    r AS (SELECT candidate_id, {sql_scaled(vocab.SCORE_WEIGHTS)} AS raw FROM s CROSS JOIN m)
    SELECT candidate_id, CAST(round_even(raw, 0) AS BIGINT) AS score FROM r WHERE raw > 0
    ORDER BY round(raw, 9) DESC, candidate_id LIMIT 100
""")
def vector_score_topk(spark, sf):
    request = lookup(vector_vacancies(spark, sf), "vacancy_id", 7)  # the opening a recruiter names
    return matching.score_request(vector_candidates(spark, sf), request)


@query("vector_score_legacy", f"""
    WITH x AS ({SQL_VECTORS}),
    s AS (SELECT c.vec_id AS candidate_id, {SQL_SIMS} FROM x c CROSS JOIN (SELECT * FROM x WHERE vec_id = 7) v),
    r AS (SELECT candidate_id, 40 * s1 + 30 * s2 + 20 * s3 + 5 * s4 AS raw FROM s)
    SELECT candidate_id, CAST(round_even(raw, 0) AS BIGINT) AS score FROM r WHERE raw > 0
""")
def vector_score_legacy(spark, sf):
    request = lookup(vector_vacancies(spark, sf), "vacancy_id", 7)  # the opening a recruiter names
    return matching.score_request(
        vector_candidates(spark, sf), request, k=None, weights=vocab.OLDER_SCORE_WEIGHTS, scale=False)


SQL_MATCH_SIDES = f"""
    x AS (SELECT *, 36 + (vec_id * 37 % 1100) / 100.0::DOUBLE AS latitude, 6 + (vec_id * 53 % 1250) / 100.0::DOUBLE AS longitude,
            'Region_' || (label % 3) AS region, CAST(18 + vec_id % 50 AS INTEGER) AS age,
            CASE label % 4 WHEN 0 THEN 'Locale' WHEN 1 THEN 'Regionale' WHEN 2 THEN 'Internazionale' END AS desired_location
          FROM ({SQL_VECTORS})),
    s AS (SELECT v.vec_id AS vacancy_id, c.vec_id AS candidate_id, {SQL_SIMS} FROM x v JOIN x c
          ON c.age <= 30 + v.label * 3
          AND (coalesce(c.desired_location = 'Internazionale', false)
            OR coalesce(c.desired_location = 'Regionale' AND c.region = v.region, false)
            OR {SQL_HAVERSINE.format(a='v', b='c')} <= 150))"""


SQL_BATCH_MATCH = f"""
    WITH {SQL_MATCH_SIDES},
    m AS (SELECT vacancy_id, min(s1) AS m1, min(s2) AS m2, min(s3) AS m3, min(s4) AS m4 FROM s GROUP BY vacancy_id),
    r AS (SELECT vacancy_id, candidate_id, {sql_scaled(vocab.SCORE_WEIGHTS)} AS raw FROM s JOIN m USING (vacancy_id))
    SELECT vacancy_id, candidate_id, CAST(round_even(raw, 0) AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY round(raw, 9) DESC, candidate_id) AS rank FROM r WHERE raw > 0)
    WHERE rank <= 20
"""


def match_sides(spark, sf):
    def placed(df, key):
        k = F.col(key)
        return df.withColumns({
            "latitude": 36 + (k * 37 % 1100) / 100, "longitude": 6 + (k * 53 % 1250) / 100,
            "region": F.concat(F.lit("Region_"), F.col("label") % 3)})

    mobility = F.when(F.col("label") % 4 == 0, F.lit("Locale")).when(
        F.col("label") % 4 == 1, F.lit("Regionale")).when(F.col("label") % 4 == 2, F.lit("Internazionale"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    people = placed(vector_candidates(spark, sf), "candidate_id").withColumns({
        "desired_location": mobility, "country": F.lit("Italia"), "location": text,
        "age": (18 + F.col("candidate_id") % 50).cast("int"), "salary_low": number, "date_available": F.lit(None).cast("date"),
        "parttime_preferenza_perc": number, "turno_preferenza": F.lit(None).cast("array<string>"), "education": text,
        "skills": text, "languages": text, "certifications": text})
    none = F.array().cast("array<string>")
    openings = placed(vector_vacancies(spark, sf), "vacancy_id").withColumns({
        "location": text, "max_distance": F.lit(150.0), "max_age": (30 + F.col("label") * 3).cast("int"), "max_ral": number,
        "date_available": F.lit(None).cast("date"), "parttime_preferenza_perc": number,
        "turno_preferenza": F.lit(None).cast("array<string>"), "education_mand": text,
        "skills_mand": none, "languages_mand": none, "certifications_mand": none})
    return openings, people


@query("batch_match_topk", SQL_BATCH_MATCH)
def batch_match_topk(spark, sf):
    return matching.match_all(*match_sides(spark, sf), k=20)


@query("batch_match_tiled", SQL_BATCH_MATCH)
def batch_match_tiled(spark, sf):
    return matching.match_all(*match_sides(spark, sf), k=20, sent_vacancies=0, cell=2.0)


# --- ratings ---------------------------------------------------------------------------

def _last_jobs(spark, sf):
    """The last three event types of each user as jobs."""
    newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    e = read_table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    ranked = e.withColumn("n", F.row_number().over(newest)).where("n <= 3")
    return ranked.groupBy("user_id").agg(*[
        F.max(F.when(F.col("n") == i, F.col("event_type"))).alias(name)
        for i, name in ((1, "last_job"), (2, "second_last_job"), (3, "third_last_job"))])


SQL_JOBS = """
    SELECT user_id, max(CASE WHEN n = 1 THEN event_type END) AS last_job, max(CASE WHEN n = 2 THEN event_type END) AS second_last_job,
        max(CASE WHEN n = 3 THEN event_type END) AS third_last_job
    FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    WHERE n <= 3 GROUP BY user_id"""


def sql_rating(role: str, third_only: int) -> str:
    a, b, c = (f"coalesce(contains(lower({x}), '{role}'), false)" for x in ("last_job", "second_last_job", "third_last_job"))
    return (f"CASE WHEN {a} THEN CASE WHEN {b} AND {c} THEN 100 WHEN {b} THEN 85 WHEN {c} THEN 70 ELSE 55 END "
            f"WHEN {b} THEN CASE WHEN {c} THEN 40 ELSE 25 END WHEN {c} THEN {third_only} ELSE 0 END")


@query("job_rubric", f"""
    SELECT user_id, last_job, second_last_job, third_last_job, {sql_rating('click', 0)} AS rating FROM ({SQL_JOBS})
""")
def job_rubric(spark, sf):
    rating = rubric.job_rating(F.lit("Click"), F.col("last_job"), F.col("second_last_job"), F.col("third_last_job"))
    return _last_jobs(spark, sf).withColumn("rating", rating)


@query("bonus_rating", f"""
    SELECT user_id, CAST(least(100, {sql_rating('view', 10)} + (CASE WHEN contains(last_job, 'i') THEN 1 ELSE 0 END)
        + (CASE WHEN contains(last_job, 'pur') THEN 1 ELSE 0 END)
        + CASE WHEN contains(coalesce(second_last_job, ''), 'sign') THEN 5 ELSE 0 END) AS INTEGER) AS rating FROM ({SQL_JOBS})
""")
def bonus_rating(spark, sf):
    jobs = [F.col(c) for c in ("last_job", "second_last_job", "third_last_job")]
    bonuses = [rubric.count_of(jobs[0], F.lit("i, PUR")),
               F.when(rubric.has_all(jobs[1], F.lit("sign")), F.lit(5)).otherwise(F.lit(0))]
    return _last_jobs(spark, sf).select("user_id", rubric.bonus_rating(F.lit("View"), *jobs, bonuses).alias("rating"))


SQL_LEVEL = "(CASE lower({0}) WHEN 'small' THEN 1 WHEN 'medium' THEN 2 WHEN 'large' THEN 3 WHEN 'economy' THEN 4 END)"


@query("requirement_checks", f"""
    SELECT p_partkey, contains(lower(p_name), 'red') AND contains(lower(p_name), 'ring') AS has_all,
        CAST(contains(lower(p_name), 'red') AS INTEGER) + CAST(contains(lower(p_name), 'bolt') AS INTEGER)
            + CAST(contains(lower(p_name), 'blue') AS INTEGER) AS hits,
        coalesce({SQL_LEVEL.format('p_type')} >= 2, false) AS level_ok, coalesce({SQL_LEVEL.format('p_type')} - 2, 0) AS levels_above
    FROM part
""")
def requirement_checks(spark, sf):
    levels = ["SMALL", "MEDIUM", "LARGE", "ECONOMY"]
    name, kind, needed = F.col("p_name"), F.col("p_type"), F.lit("Medium")
    return read_table(spark, sf, "part").select(
        "p_partkey", rubric.has_all(name, F.lit("Red, ring")).alias("has_all"),
        rubric.count_of(name, F.lit("red, Bolt,blue")).alias("hits"),
        rubric.at_least_level(kind, needed, levels).alias("level_ok"),
        rubric.levels_above(kind, needed, levels).cast("int").alias("levels_above"))


@query("gate_and_sum", """
    WITH a AS (
        SELECT p_partkey, CASE WHEN p_size < 5 THEN 'maybe' WHEN p_size < 25 THEN 'True' ELSE 'false' END AS mand_skills,
            CASE p_type WHEN 'PROMO' THEN 'f' WHEN 'SMALL' THEN NULL ELSE 't' END AS mand_languages,
            CASE WHEN p_size % 3 = 0 THEN 'voto 10' ELSE CAST(p_size * 1.5 AS VARCHAR) END AS score_jobs, CAST(p_size % 4 AS VARCHAR) AS score_skills
        FROM part)
    SELECT p_partkey, CAST(round(coalesce(TRY_CAST(score_jobs AS DOUBLE), 0) + coalesce(TRY_CAST(score_skills AS DOUBLE), 0)) AS BIGINT) AS score
    FROM a WHERE mand_skills = 'True' AND mand_languages = 't'
      AND round(coalesce(TRY_CAST(score_jobs AS DOUBLE), 0) + coalesce(TRY_CAST(score_skills AS DOUBLE), 0)) > 0
""")
def gate_and_sum(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    answers = read_table(spark, sf, "part").select(
        "p_partkey",
        F.when(size < 5, F.lit("maybe")).when(size < 25, F.lit("True")).otherwise(F.lit("false")).alias("mand_skills"),
        F.when(kind == "PROMO", F.lit("f")).when(kind == "SMALL", F.lit(None)).otherwise(F.lit("t")).alias("mand_languages"),
        F.when(size % 3 == 0, F.lit("voto 10")).otherwise((size * 1.5).cast("string")).alias("score_jobs"),
        (size % 4).cast("string").alias("score_skills"))
    return rubric.gate_and_sum(answers)


# --- synonyms: part types are roles, the part names of a type its synonyms ---------------

def role_dictionary(spark, sf):
    listed = read_table(spark, sf, "part").groupBy(F.col("p_type").alias("role")).agg(
        F.array_sort(F.collect_set("p_name")).alias("synonyms"))
    return synonyms.dictionary(listed)


def role_queries(spark, sf):
    return read_table(spark, sf, "part").select(
        "p_partkey", F.concat(F.col("p_size").cast("string"), "p_name", F.lit("s")).alias("query"))


SQL_NORM = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query("synonym_expand", f"""
    WITH d AS (SELECT p_type AS role, p_name AS term, row_number() OVER (PARTITION BY p_type ORDER BY p_name) - 1 AS term_pos
               FROM (SELECT DISTINCT p_type, p_name FROM part)),
    sp AS (SELECT norm, arg_min(role, (role, term_pos)) AS role FROM (
        SELECT role, -1 AS term_pos, {SQL_NORM.format('role')} AS norm FROM d
        UNION SELECT role, term_pos, {SQL_NORM.format('term')} FROM d) GROUP BY norm),
    q AS (SELECT DISTINCT {SQL_NORM.format("p_size || p_name || 's'")} AS qn FROM part),
    h AS (SELECT DISTINCT qn, role FROM q JOIN sp ON contains(norm, qn) OR contains(qn, norm)
          OR 1 - levenshtein(qn, norm)::DOUBLE / greatest(length(qn), length(norm)) >= 0.85),
    t AS (SELECT qn, term, min((role, term_pos)) AS pos FROM h JOIN d USING (role) GROUP BY qn, term),
    f AS (SELECT qn, string_agg(term, ', ' ORDER BY pos) AS synonyms FROM t GROUP BY qn)
    SELECT p_partkey, synonyms FROM part LEFT JOIN f ON {SQL_NORM.format("p_size || p_name || 's'")} = qn
""")
def synonym_expand(spark, sf):
    found = synonyms.expand_roles(role_queries(spark, sf), "query", role_dictionary(spark, sf))
    return found.select("p_partkey", F.array_join("synonyms", ", ").alias("synonyms"))
