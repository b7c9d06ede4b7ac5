"""Whole jobs on the driver tables: versioned chats, runs with rejects, matching openings, a cost study."""

import uuid

from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.operators import notes
from matchspark.plans import jobs
from matchspark.plans.feature_queries import SQL_CITIES, raw_cities
from matchspark.plans.match_queries import (
    SQL_HAVERSINE,
    SQL_MATCH_SIDES,
    SQL_SIMS,
    match_sides,
    sql_scaled,
)
from matchspark.plans.registry import query
from matchspark.session import shared_folder
from matchspark.sources import tables
from matchspark.sources.tables import load_cities, read_table


@query("chat_thread_versions", """
    WITH v AS (
        SELECT conv_id * 1000 + turn AS noteid, conv_id, role AS action, text AS comments, TIMESTAMP '2024-01-01' + to_days(CAST(turn * 9 AS INTEGER)) AS seen, 0 AS gone
        FROM conversations
        UNION ALL
        SELECT conv_id * 1000 + turn, conv_id, role, text || ' bis', TIMESTAMP '2024-01-02' + to_days(CAST(turn * 9 AS INTEGER)), CAST(turn % 2 AS INTEGER)
        FROM conversations WHERE turn % 3 = 0),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY noteid ORDER BY seen DESC, comments DESC) AS rn FROM v)
          WHERE rn = 1 AND gone = 0 AND action ILIKE '%user%' AND comments ILIKE '%on%')
    SELECT conv_id AS candidateid, string_agg(comments, ' || ' ORDER BY seen, noteid) AS chatwa FROM l GROUP BY conv_id
""")
def chat_thread_versions(spark, sf):
    c = read_table(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("int"))
    at = lambda day: F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(F.col("turn") * 9)
    named = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("noteid"), F.col("conv_id").alias("personreferenceid"),
                     F.col("role").alias("action"), F.col("text").alias("comments"), "turn")
    first = named.select("*", at("2024-01-01").alias("load_datetimestamp"), F.lit(0).alias("isdeleted"))
    second = named.where("turn % 3 = 0").select("*", at("2024-01-02").alias("load_datetimestamp"), (F.col("turn") % 2).alias("isdeleted"))
    second = second.withColumn("comments", F.concat("comments", F.lit(" bis")))
    return notes.chat_threads(first.unionByName(second), "user", "on")


@query("run_rejects", """
    SELECT p_partkey AS joborderid, 'sorry, no answer' AS answer FROM part WHERE contains(p_name, 'red')
""")
def run_rejects(spark, sf):
    from matchspark.operators.extraction import vacancy_rules

    rules = vacancy_rules()
    openings = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("joborderid"), F.col("p_type").alias("jobtitle"),
        F.concat(F.lit("cercasi "), "p_name").alias("description")).withColumn("description_raw", F.col("description"))
    root = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    jobs.run_vacancies(
        spark, openings, root, F.lit("2024-02-01").cast("timestamp_ntz"), dims=8,
        provider=lambda c: F.when(F.contains(c, F.lit("red")), F.lit("Sorry, no answer")).otherwise(rules(c)))
    return tables.current(spark, f"{root}/vacancy_rejects")


@query("match_from_vacancies", f"""
    WITH {SQL_MATCH_SIDES.split("s AS (SELECT v.vec_id")[0]}
    c AS ({SQL_CITIES}),
    k AS (SELECT lower(city_name) AS city, arg_min_null(latitude, unique_identifier) AS latitude, arg_min_null(longitude, unique_identifier) AS longitude FROM c GROUP BY 1),
    o AS (SELECT x.* EXCLUDE (latitude, longitude), k.latitude, k.longitude FROM x LEFT JOIN k ON 'city_' || (vec_id % 40) = city),
    s AS (SELECT v.vec_id AS vacancy_id, c.vec_id AS candidate_id, {SQL_SIMS} FROM o v JOIN x c
          ON coalesce(c.desired_location = 'Internazionale', false) OR coalesce({SQL_HAVERSINE.format(a='v', b='c')} <= 150, false)),
    m AS (SELECT vacancy_id, min(s1) AS m1, min(s2) AS m2, min(s3) AS m3, min(s4) AS m4 FROM s GROUP BY vacancy_id),
    r AS (SELECT vacancy_id, candidate_id, {sql_scaled(vocab.SCORE_WEIGHTS)} AS raw FROM s JOIN m USING (vacancy_id))
    SELECT vacancy_id, candidate_id, CAST(round_even(raw, 0) AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY round(raw, 9) DESC, candidate_id) AS rank FROM r WHERE raw > 0)
    WHERE rank <= 10
""")
def match_from_vacancies(spark, sf):
    openings, people = match_sides(spark, sf)
    text = F.lit(None).cast("string")
    vacancies = openings.select(
        F.col("vacancy_id").alias("joborderid"), F.concat(F.lit(" CITY_"), (F.col("vacancy_id") % 40).cast("string")).alias("location"),
        text.alias("region"), F.lit(None).cast("date").alias("date_available"), F.lit(None).cast("int").alias("parttime_preferenza_perc"),
        text.alias("turno_preferenza"), text.alias("languages"), "jobtitle_emb", "skills_emb")
    return jobs.match_vacancies(
        vacancies, people.withColumnRenamed("candidate_id", "candidateid"), load_cities(raw_cities(spark, sf)), k=10, max_distance=150.0)


@query("cost_study", f"""
    WITH t AS (SELECT text FROM documents WHERE trim(text) <> '' ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100),
    a AS (SELECT text, CASE WHEN length(text) % 3 = 0 THEN 'no' ELSE '{{"lang": "x", "n": "' || length(text) || '"}}' END AS answer FROM t),
    s AS (SELECT answer <> 'no' AS valid, count(*) AS n, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens_in,
            CAST(sum(ceil(length(answer) / 4.0)) AS BIGINT) AS tokens_out FROM a GROUP BY 1),
    p(model, cost_in, cost_out) AS (VALUES {", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in vocab.MODEL_PRICES)})
    SELECT valid, model, n AS rows, tokens_in, tokens_out, round((tokens_in * cost_in + tokens_out * cost_out) / 1e6, 9) AS credits_total
    FROM s CROSS JOIN p
""")
def cost_study(spark, sf):
    answer = lambda c: F.when(F.length(c) % 3 == 0, F.lit("no")).otherwise(
        F.concat(F.lit('{"lang": "x", "n": "'), F.length(c).cast("string"), F.lit('"}')))
    study = jobs.cost_study(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", answer, ["lang", "n"])
    return study.select("valid", "model", "rows", "tokens_in", "tokens_out", F.round("credits_total", 9).alias("credits_total"))
