"""Feature building, model answers, places and incremental runs on the driver tables."""

from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions import filters, geo, jsonx, text, vectors
from matchspark.functions.once import where_computed
from matchspark.operators import cost, extraction, features, geography, incremental
from matchspark.plans.registry import query
from matchspark.sources.tables import load_cities, read_table, spread


# --- small features --------------------------------------------------------------

@query("vacancy_text", """
    WITH v AS (
        SELECT p_partkey, CASE WHEN p_size > 30 THEN NULL ELSE p_name END AS skills,
               CASE WHEN p_size BETWEEN 20 AND 40 THEN ' ' ELSE p_type END AS titles,
               CASE WHEN p_size > 40 THEN '' ELSE p_brand END AS notes
        FROM part)
    SELECT p_partkey, CASE WHEN coalesce(nullif(trim(skills), ''), nullif(trim(titles), ''), nullif(trim(notes), '')) IS NOT NULL
        THEN 'Skills richieste: ' || coalesce(skills, '') || ' | Titoli: ' || coalesce(titles, '') || ' | Note: ' || coalesce(notes, '')
        END AS description
    FROM v
""")
def vacancy_text(spark, sf):
    size = F.col("p_size")
    v = read_table(spark, sf, "part").select(
        "p_partkey",
        F.when(~(size > 30), F.col("p_name")).alias("skills"),
        F.when(size.between(20, 40), F.lit(" ")).otherwise(F.col("p_type")).alias("titles"),
        F.when(size > 40, F.lit("")).otherwise(F.col("p_brand")).alias("notes"))
    described = features.vacancy_text([
        ("Skills richieste: ", F.col("skills")), ("Titoli: ", F.col("titles")), ("Note: ", F.col("notes"))])
    return v.select("p_partkey", described.alias("description"))


@query("mobility_level", """
    SELECT p_partkey, CASE
        WHEN p_name || ' ' || p_type ILIKE '%standard%' THEN 'Standard'
        WHEN p_name || ' ' || p_type ILIKE '%large%' THEN 'Large'
        WHEN p_name || ' ' || p_type ILIKE '%medium%' THEN 'Medium'
        WHEN p_name || ' ' || p_type ILIKE '%small%' THEN 'Small' END AS level
    FROM part
""")
def mobility_level(spark, sf):
    named = F.concat_ws(" ", "p_name", "p_type")
    return read_table(spark, sf, "part").select(
        "p_partkey", features.highest_level(named, ["Small", "Medium", "Large", "Standard"]).alias("level"))


@query("shift_split_append", """
    WITH s AS (
        SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE
            list_filter(list_transform(string_split(replace(p_name, ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> '') END AS shifts,
            CASE WHEN p_size > 25 THEN ' True' ELSE 'False' END AS answer
        FROM part)
    SELECT p_partkey, array_to_string(CASE
        WHEN lower(trim(answer)) = 'true' AND NOT coalesce(contains(array_to_string(shifts, ','), 'ring'), false)
        THEN list_append(coalesce(shifts, []), 'ring') ELSE shifts END, '|') AS shifts
    FROM s
""")
def shift_split_append(spark, sf):
    listed = F.when(F.col("p_size") != 50, F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ")))
    s = read_table(spark, sf, "part").select(
        "p_partkey", text.split_members(listed).alias("shifts"),
        F.when(F.col("p_size") > 25, F.lit(" True")).otherwise(F.lit("False")).alias("answer"))
    grown = features.append_shift(F.col("shifts"), F.col("answer"), "ring")
    return s.select("p_partkey", F.array_join(grown, "|").alias("shifts"))


@query("part_time_max", f"""
    WITH p AS (
        SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL
            ELSE CAST(l_quantity * 2 AS INTEGER) || '%, ' || CAST(round(l_tax * 1000) AS INTEGER) || '%' END AS stated
        FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, stated, nullif(greatest({", ".join(
        f"CASE WHEN contains(coalesce(stated, '100%'), '{v}') THEN {v} ELSE 0 END" for v in vocab.PART_TIME_PERCENTS)}), 0) AS percent,
        list_max(list_transform(string_split(regexp_replace(coalesce(stated, '1000'), '[^0-9,]', ',', 'g'), ','),
            lambda x: TRY_CAST(x AS INTEGER))) AS largest
    FROM p
""")
def part_time_max(spark, sf):
    stated = F.when(F.col("l_linenumber") != 7, F.concat(
        (F.col("l_quantity") * 2).cast("int"), F.lit("%, "), F.round(F.col("l_tax") * 1000).cast("int"), F.lit("%")))
    p = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", stated.alias("stated"))
    return p.withColumns({
        "percent": features.largest_percent(F.col("stated"), vocab.PART_TIME_PERCENTS),
        "largest": features.largest_number(F.col("stated"))})


@query("education_rank", """
    SELECT o_orderkey, rank FROM (
        SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '5-low' THEN 1 WHEN '4-not specified' THEN 2
            WHEN '3-medium' THEN 3 WHEN '2-high' THEN 4 END AS rank FROM orders)
    WHERE rank >= 3
""")
def education_rank(spark, sf):
    levels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
    rank = filters.level_rank(F.col("o_orderpriority"), levels)
    return read_table(spark, sf, "orders").select("o_orderkey", rank.cast("int").alias("rank")).where("rank >= 3")


@query("request_from_vacancy", f"""
    WITH v AS (
        SELECT 'JO-' || o_orderkey AS joborderid, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority END AS jobtitle,
            o_totalprice AS salary_low, o_orderdate AS date_available,
            CASE o_orderstatus WHEN 'F' THEN 'notte , MATTINA, altro' WHEN 'O' THEN 'Sera' END AS turno_preferenza,
            CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey % 101 AS INTEGER) END AS pct,
            CASE WHEN o_orderpriority = '2-HIGH' THEN 'francese, Klingon,ITALIANO' END AS languages
        FROM orders)
    SELECT CAST(regexp_replace(joborderid, '[^0-9]', '', 'g') AS BIGINT) AS joborderid, nullif(trim(jobtitle), '') AS role,
        salary_low AS max_ral, date_available,
        array_to_string(list_filter(['Mattina', 'Pomeriggio', 'Notte', 'Fine Settimana'], lambda a: coalesce(list_contains(
            list_transform(string_split(turno_preferenza, ','), lambda x: lower(trim(x))), lower(a)), false)), ', ') AS turno_preferenza,
        CAST(coalesce(CASE WHEN pct < 10 THEN 10 WHEN pct % 10 <= 5 THEN pct - pct % 10 ELSE pct - pct % 10 + 10 END, 0) AS INTEGER) AS parttime_preferenza_perc,
        array_to_string(list_filter([{", ".join(f"'{x}'" for x in vocab.LANGUAGES)}], lambda a: coalesce(list_contains(
            list_transform(string_split(languages, ','), lambda x: lower(trim(x))), lower(a)), false)), ', ') AS languages_opt
    FROM v
""")
def request_from_vacancy(spark, sf):
    status, none = F.col("o_orderstatus"), F.lit(None).cast("string")
    v = spread(read_table(spark, sf, "orders")).select(
        F.concat(F.lit("JO-"), "o_orderkey").alias("joborderid"),
        F.when(status == "P", F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("jobtitle"),
        none.alias("location"), none.alias("region"), none.alias("country"),
        F.col("o_totalprice").alias("salary_low"), F.col("o_orderdate").alias("date_available"),
        F.when(status == "F", F.lit("notte , MATTINA, altro")).when(status == "O", F.lit("Sera")).alias("turno_preferenza"),
        F.when(status != "P", (F.col("o_custkey") % 101).cast("int")).alias("parttime_preferenza_perc"),
        none.alias("skills"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("francese, Klingon,ITALIANO")).alias("languages"),
        none.alias("education"), none.alias("certifications"))
    r = features.request_from_vacancy(v)
    return r.select(
        "joborderid", "role", "max_ral", "date_available",
        F.array_join("turno_preferenza", ", ").alias("turno_preferenza"), "parttime_preferenza_perc",
        F.array_join("languages_opt", ", ").alias("languages_opt"))


@query("result_shape", f"""
    SELECT CAST(round(c_acctbal) AS BIGINT) AS "Score", c_custkey AS "ID Candidato", c_name AS "Nome",
        '[Open Link]({vocab.PROFILE_URL}' || c_custkey || ')' AS "URL",
        c_mktsegment || ', ' || c_name AS "Preferenza turno"
    FROM customer
""")
def result_shape(spark, sf):
    c = read_table(spark, sf, "customer").select(
        F.round("c_acctbal").cast("long").alias("score"), F.col("c_custkey").alias("candidateid"),
        F.col("c_name").alias("first_name"), F.array("c_mktsegment", "c_name").alias("turno_preferenza"))
    return features.shape_result(c, {"turno_preferenza": ["Notte"]})


# --- JSON -------------------------------------------------------------------------

# Model-like answers made of the events' JSON: fenced, quoted, escaped, cut off.
SQL_ANSWERS = """
    SELECT event_id, user_id, CASE event_type
        WHEN 'view' THEN '  ```JSON' || chr(10) || props || chr(10) || '```'
        WHEN 'click' THEN '```json' || props || chr(9) || '"'
        WHEN 'purchase' THEN replace(props, '"', '\\"')
        WHEN 'signup' THEN substr(props, 1, length(props) - 1)
        ELSE props END AS answer
    FROM events"""


def sql_repair(c: str) -> str:
    b = text.BLANK_CLASS
    out = f"regexp_replace(lower({c}), '^{b}*```json{b}*', '')"
    out = f"replace({out}, '\\', '')"
    out = f"regexp_replace({out}, '{b}+', ' ', 'g')"
    out = f"regexp_replace({out}, '^{b}+|{b}+$', '', 'g')"
    out = f"regexp_replace({out}, '{b}*```$', '')"
    return f"""regexp_replace({out}, '{b}*["'']$', '')"""


def answers(spark, sf):
    kind, props = F.col("event_type"), F.col("props")
    answer = (
        F.when(kind == "view", F.concat(F.lit("  ```JSON\n"), props, F.lit("\n```")))
        .when(kind == "click", F.concat(F.lit("```json"), props, F.lit('\t"')))
        .when(kind == "purchase", F.replace(props, F.lit('"'), F.lit('\\"')))
        .when(kind == "signup", F.expr("substr(props, 1, length(props) - 1)"))
        .otherwise(props)
    )
    return spread(read_table(spark, sf, "events")).select("event_id", "user_id", answer.alias("answer"))


@query("json_repair", f"""
    WITH a AS ({SQL_ANSWERS}), r AS (SELECT event_id, {sql_repair('answer')} AS repaired FROM a)
    SELECT event_id, repaired, json_valid(repaired) AS is_valid FROM r
""")
def json_repair(spark, sf):
    repaired = answers(spark, sf).select("event_id", jsonx.repair_json(F.col("answer")).alias("repaired"))
    return repaired.withColumn("is_valid", jsonx.is_valid_json(F.col("repaired")))


@query("json_extract", f"""
    WITH a AS ({SQL_ANSWERS}), r AS (SELECT event_id, {sql_repair('answer')} AS repaired FROM a)
    SELECT event_id, json_extract_string(repaired, '$.k') AS k,
        CASE WHEN TRY_CAST(json_extract_string(repaired, '$.k') AS INTEGER) BETWEEN 1 AND 60
            THEN TRY_CAST(json_extract_string(repaired, '$.k') AS INTEGER) END AS age,
        json_extract_string(repaired, '$.missing') AS missing
    FROM r WHERE json_valid(repaired)
""")
def json_extract(spark, sf):
    parsed = where_computed(
        answers(spark, sf), "j", jsonx.parse_json(jsonx.repair_json(F.col("answer"))), lambda j: j.isNotNull())
    found = parsed.select("event_id", *jsonx.fields(F.col("j"), ["k", "missing"]))
    return found.select("event_id", "k", jsonx.valid_int(F.col("k"), 1, 60).alias("age"), "missing")


@query("json_completeness", """
    SELECT event_type, count(*) AS answers,
        count(*) FILTER (WHERE NOT (contains(props, '"k"') AND contains(props, '7'))) AS incomplete
    FROM events GROUP BY event_type
""")
def json_completeness(spark, sf):
    e = read_table(spark, sf, "events").select("event_type", jsonx.has_keys(F.col("props"), ['"k"', "7"]).alias("complete"))
    return e.groupBy("event_type").agg(F.count("*").alias("answers"), F.count_if(~F.col("complete")).alias("incomplete"))


@query("field_validation", f"""
    WITH f AS (
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN lpad(c_custkey::VARCHAR, 6, '0') WHEN 'MACHINERY' THEN '12a45'
                ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS zip,
            CASE c_nationkey WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'n/a' ELSE CAST(c_custkey % 170 AS VARCHAR) END AS age,
            '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 13 AS VARCHAR), 2, '0') || '-'
                || lpad(CAST(c_custkey % 33 AS VARCHAR), 2, '0') AS born,
            CASE c_nationkey WHEN 3 THEN ' NULL' WHEN 4 THEN '  ' WHEN 5 THEN 'None' ELSE c_mktsegment END AS skills
        FROM customer)
    SELECT c_custkey, CASE WHEN regexp_full_match(zip, '[0-9]{{5}}') THEN zip END AS zip_code,
        CASE WHEN regexp_full_match(age, '[0-9]+') AND TRY_CAST(age AS INTEGER) BETWEEN 1 AND 150 THEN TRY_CAST(age AS INTEGER) END AS age,
        CASE WHEN regexp_full_match(born, '{vocab.BIRTH_PATTERN[1:-1]}') THEN CAST(born AS DATE)::VARCHAR END AS date_of_birth,
        CASE WHEN trim(skills) <> '' AND lower(trim(skills)) NOT IN ('null', 'none', 'nan') THEN skills END AS skills
    FROM f
""")
def field_validation(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    pad = lambda n, w: F.lpad(n.cast("string"), w, "0")
    f = read_table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", pad(key, 6)).when(F.col("c_mktsegment") == "MACHINERY", F.lit("12a45"))
        .otherwise(pad(key, 5)).alias("zip_code"),
        F.when(nation == 0, F.lit("")).when(nation == 1, F.lit("nan")).when(nation == 2, F.lit("n/a"))
        .otherwise((key % 170).cast("string")).alias("age"),
        F.concat(F.lit("19"), pad(key % 100, 2), F.lit("-"), pad(key % 13, 2), F.lit("-"), pad(key % 33, 2)).alias("date_of_birth"),
        F.when(nation == 3, F.lit(" NULL")).when(nation == 4, F.lit("  ")).when(nation == 5, F.lit("None"))
        .otherwise(F.col("c_mktsegment")).alias("skills"))
    checked = jsonx.validated(["zip_code", "age", "date_of_birth", "skills"], jsonx.CANDIDATE_RULES)
    return f.select("c_custkey", *checked).withColumn("date_of_birth", F.col("date_of_birth").cast("string"))


# --- model answers -----------------------------------------------------------------

SQL_CV = """
    SELECT c_custkey AS candidateid, 'Nome ' || c_name || ' | Domicilio: NATION_' || c_nationkey || ' | CAP ' ||
        lpad(CAST(c_custkey AS VARCHAR), 5, '0') || ' | Eta: ' || CAST(c_custkey % 160 AS VARCHAR) || ' | nato il 19' ||
        lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-02-' || lpad(CAST(c_custkey % 31 AS VARCHAR), 2, '0') ||
        ' | Ultimo lavoro: ' || c_mktsegment || CASE WHEN c_acctbal > 5000 THEN ' | Inglese e russo' ELSE '' END ||
        CASE WHEN c_acctbal < 2000 THEN ' | Laurea Triennale in Puglia' ELSE '' END AS description
    FROM customer"""


def cvs(spark, sf):
    key = F.col("c_custkey")
    pad = lambda n, w: F.lpad(n.cast("string"), w, "0")
    described = F.concat(
        F.lit("Nome "), "c_name", F.lit(" | Domicilio: NATION_"), "c_nationkey", F.lit(" | CAP "), pad(key, 5),
        F.lit(" | Eta: "), (key % 160).cast("string"), F.lit(" | nato il 19"), pad(key % 100, 2), F.lit("-02-"), pad(key % 31, 2),
        F.lit(" | Ultimo lavoro: "), "c_mktsegment",
        F.when(F.col("c_acctbal") > 5000, F.lit(" | Inglese e russo")).otherwise(F.lit("")),
        F.when(F.col("c_acctbal") < 2000, F.lit(" | Laurea Triennale in Puglia")).otherwise(F.lit("")))
    return spread(read_table(spark, sf, "customer")).select(key.alias("candidateid"), described.alias("description"))


@query("rule_extraction", f"""
    WITH cv AS ({SQL_CV}), x AS (
        SELECT candidateid, regexp_extract(description, 'CAP ([0-9]{{5}})', 1) AS zip,
            TRY_CAST(regexp_extract(description, 'Eta: ([0-9]+)', 1) AS INTEGER) AS age,
            regexp_extract(description, '19[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') AS born,
            trim(regexp_extract(description, 'Domicilio: ([^|]*)', 1)) AS location,
            trim(regexp_extract(description, 'Ultimo lavoro: ([^|]*)', 1)) AS last_job, description
        FROM cv)
    SELECT candidateid, CASE WHEN age BETWEEN 1 AND 150 THEN age END AS age,
        CASE WHEN regexp_full_match(born, '{vocab.BIRTH_PATTERN[1:-1]}') THEN born END AS date_of_birth,
        lower(location) AS location, CASE WHEN contains(description, 'Puglia') THEN 'puglia' END AS region,
        CASE WHEN zip <> '' THEN zip END AS zip_code, lower(last_job) AS last_job,
        CASE WHEN contains(description, 'Inglese') THEN 'inglese, russo' END AS languages,
        CASE WHEN contains(description, 'Laurea') THEN 'laurea triennale' END AS education
    FROM x
""")
def rule_extraction(spark, sf):
    found, _ = extraction.extract_candidates(cvs(spark, sf))
    return found.select(
        "candidateid", "age", F.col("date_of_birth").cast("string").alias("date_of_birth"), "location", "region",
        "zip_code", "last_job", "languages", "education")


@query("prompt_dedupe", """
    SELECT conv_id, turn, md5('Testo: ' || role || text) AS answer FROM conversations
""")
def prompt_dedupe(spark, sf):
    c = read_table(spark, sf, "conversations")
    prompt = F.concat(F.lit("Testo: "), "role", "text")
    return extraction.ask(c, prompt, F.md5, "answer", dedupe=True).select("conv_id", "turn", "answer")


@query("weekend_answer_join", """
    WITH chats AS (
        SELECT conv_id, string_agg(text || '? ' || CASE role WHEN 'user' THEN 'Si certo' WHEN 'assistant' THEN 'No, non posso' ELSE 'forse' END,
            ' || ' ORDER BY turn, text) AS chatwa, max_by(role, turn) AS last_role
        FROM conversations GROUP BY conv_id)
    SELECT c_custkey AS candidateid,
        CASE WHEN last_role = 'user' THEN 'True' ELSE 'False' END AS weekend,
        CASE WHEN last_role = 'user' THEN 'Mattina|Fine Settimana' ELSE 'Mattina' END AS shifts
    FROM customer LEFT JOIN chats ON conv_id = c_custkey
""")
def weekend_answer_join(spark, sf):
    from matchspark.operators import notes
    reply = F.when(F.col("role") == "user", F.lit("Si certo")).when(
        F.col("role") == "assistant", F.lit("No, non posso")).otherwise(F.lit("forse"))
    lines = read_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("candidateid"), "turn", F.concat("text", F.lit("? "), reply).alias("text"))
    chats = notes.threads(lines, "candidateid", "text", ["turn", "text"], F.floor(F.col("turn") / 16), "chatwa")
    people = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("candidateid"), F.array(F.lit("Mattina")).alias("turno_preferenza"))
    answered = extraction.ask_weekend(notes.with_threads(people, chats))
    grown = features.append_shift(F.col("turno_preferenza"), F.col("weekend"))
    return answered.select("candidateid", "weekend", F.array_join(grown, "|").alias("shifts"))


@query("hash_embedding", r"""
    WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS token FROM documents),
    b AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 1024 AS bucket, count(*) AS n FROM t GROUP BY ALL),
    l AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM b GROUP BY doc_id)
    SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(CAST(n / length AS FLOAT) AS DOUBLE), 5) AS weight FROM b JOIN l USING (doc_id)
""")
def hash_embedding(spark, sf):
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    embedded = extraction.embed(d, {"text_emb": "text"})
    # outer: a plain explode infers a filter on the vector and computes it a second time.
    return embedded.select("doc_id", F.posexplode_outer("text_emb").alias("bucket", "w")).where("w > 0").select(
        "doc_id", "bucket", F.round(F.col("w").cast("double"), 5).alias("weight"))


@query("cost_rollup", f"""
    WITH t AS (
        SELECT lang, CAST(ceil(length('Estrai i campi. Testo: ' || text) / 4.0) AS BIGINT) AS tokens_in,
            CAST(ceil(length(source || lang) / 4.0) AS BIGINT) AS tokens_out
        FROM documents WHERE trim(text) <> ''),
    s AS (SELECT lang, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM t GROUP BY lang),
    p(model, cost_in, cost_out) AS (VALUES {", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in vocab.MODEL_PRICES)})
    SELECT lang, model, n AS rows, tokens_in, tokens_out, round(tokens_in * cost_in / 1e6, 9) AS credits_in,
        round(tokens_out * cost_out / 1e6, 9) AS credits_out,
        round((tokens_in * cost_in + tokens_out * cost_out) / 1e6, 9) AS credits_total
    FROM s CROSS JOIN p
""")
def cost_rollup(spark, sf):
    d = read_table(spark, sf, "documents").where(text.not_blank(F.col("text")))
    counted = cost.with_tokens(d, F.concat(F.lit("Estrai i campi. Testo: "), "text"), F.concat("source", "lang"))
    priced = cost.cost_by_model(counted, vocab.MODEL_PRICES, "lang")
    return priced.select("lang", "model", "rows", "tokens_in", "tokens_out", *[
        F.round(c, 9).alias(c) for c in ("credits_in", "credits_out", "credits_total")])


# --- places --------------------------------------------------------------------------

# Cities made of the suppliers; some coordinates and names are unusable.
SQL_RAW_CITIES = """
    SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS unique_identifier,
        CASE WHEN s_nationkey = 7 THEN ' Null' ELSE ' City_' || CAST(s_suppkey // 2 AS VARCHAR) || ' ' END AS city_name,
        n_name AS province, CASE WHEN s_nationkey = 8 THEN 'nan' ELSE n_name END AS province_ext, r_name AS region,
        CAST(s_suppkey * 97 % 100000 AS VARCHAR) || '.0' AS zip,
        CASE WHEN s_nationkey = 9 THEN 'nan' WHEN s_nationkey = 10 THEN 'x' ELSE CAST(36 + (s_suppkey * 37 % 1100) / 100.0 AS VARCHAR) END AS latitude,
        CAST(6 + (s_suppkey * 53 % 1250) / 100.0 AS VARCHAR) AS longitude
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

SQL_CITIES = f"""
    SELECT unique_identifier, trim(city_name) AS city_name, trim(province) AS province, trim(province_ext) AS province_ext,
        trim(region) AS region, repeat('0', 5 - length(CAST(CAST(zip AS DOUBLE) AS BIGINT)::VARCHAR)) || CAST(CAST(zip AS DOUBLE) AS BIGINT)::VARCHAR AS zip,
        CASE WHEN NOT isnan(TRY_CAST(latitude AS DOUBLE)) THEN TRY_CAST(latitude AS DOUBLE) END AS latitude,
        TRY_CAST(longitude AS DOUBLE) AS longitude
    FROM ({SQL_RAW_CITIES}) WHERE lower(trim(city_name)) NOT IN ('', 'null', 'nan')"""

SQL_PEOPLE = """
    SELECT c_custkey AS candidateid, 'CITY_' || CAST(c_custkey // 25 AS VARCHAR) AS location,
        CASE WHEN c_nationkey = 3 THEN NULL ELSE lpad(CAST(c_custkey * 97 % 20000 AS VARCHAR), 5, '0') END AS zip_code
    FROM customer"""


def raw_cities(spark, sf):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return (
        read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
        .join(read_table(spark, sf, "nation"), nation == F.col("n_nationkey"))
        .join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.cast("string").alias('Unique Identifier'),
            F.when(nation == 7, F.lit(" Null")).otherwise(
                F.concat(F.lit(" City_"), F.floor(key / 2).cast("string"), F.lit(" "))).alias('"City Name"'),
            F.col("n_name").alias("Province"),
            F.when(nation == 8, F.lit("nan")).otherwise(F.col("n_name")).alias("Province Ext"),
            F.col("r_name").alias("Region"),
            F.concat((key * 97 % 100000).cast("string"), F.lit(".0")).alias("ZIP"),
            F.when(nation == 9, F.lit("nan")).when(nation == 10, F.lit("x")).otherwise(
                (36 + (key * 37 % 1100) / 100).cast("string")).alias("Latitude"),
            (6 + (key * 53 % 1250) / 100).cast("string").alias(" Longitude")))


def people(spark, sf):
    key = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(
        key.alias("candidateid"), F.concat(F.lit("CITY_"), F.floor(key / 25).cast("string")).alias("location"),
        F.when(F.col("c_nationkey") != 3, F.lpad((key * 97 % 20000).cast("string"), 5, "0")).alias("zip_code"))


@query("city_load", SQL_CITIES)
def city_load(spark, sf):
    return load_cities(raw_cities(spark, sf))


@query("zip_membership", f"""
    WITH c AS ({SQL_CITIES}), p AS ({SQL_PEOPLE})
    SELECT candidateid, location, CASE WHEN zip_code IN (SELECT zip FROM c) THEN zip_code END AS zip_code FROM p
""")
def zip_membership(spark, sf):
    return geography.known_zip(people(spark, sf), load_cities(raw_cities(spark, sf)))


SQL_LAT = "regexp_full_match(CAST(g.latitude AS VARCHAR), '[-+]?([0-8]?\\d(\\.\\d+)?|90(\\.0+)?)')"


@query("geo_enrich", f"""
    WITH c AS ({SQL_CITIES}), p AS ({SQL_PEOPLE}),
    g AS (SELECT lower(city_name) AS city, arg_min_null(zip, unique_identifier) AS zip, arg_min_null(latitude, unique_identifier) AS latitude,
            arg_min_null(longitude, unique_identifier) AS longitude, arg_min_null(province_ext, unique_identifier) AS province_ext
          FROM c GROUP BY 1)
    SELECT candidateid, location, coalesce(CASE WHEN zip_code IN (SELECT zip FROM c) THEN zip_code END, g.zip) AS zip_code,
        CASE WHEN {SQL_LAT} THEN g.latitude END AS latitude, g.longitude AS longitude,
        CASE WHEN lower(g.province_ext) <> 'nan' THEN g.province_ext END AS province_ext, 999999 AS distance_km
    FROM p LEFT JOIN g ON lower(location) = city
""")
def geo_enrich(spark, sf):
    return geography.enrich(people(spark, sf), load_cities(raw_cities(spark, sf)))


SQL_GOOD = "regexp_full_match({0}, '-?[0-9]{{1,3}}\\.[0-9]{{1,10}}')"


@query("coordinate_repair", f"""
    WITH c AS (SELECT unique_identifier, trim(city_name) AS city_name, province_ext, latitude, longitude FROM ({SQL_RAW_CITIES})),
    k AS (SELECT ' City_' || CAST(s_suppkey // 2 AS VARCHAR) || ' ' AS city_name, n_name AS province_ext,
             CASE WHEN s_acctbal > 5000 THEN '44.25' ELSE 'unknown' END AS latitude, '11.5' AS longitude
          FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    fix AS (SELECT lower(trim(city_name)) AS city, lower(trim(province_ext)) AS prov, min(latitude) AS latitude, min(longitude) AS longitude
            FROM k GROUP BY ALL)
    SELECT unique_identifier, city_name, c.province_ext,
        CASE WHEN {SQL_GOOD.format('c.latitude')} AND {SQL_GOOD.format('c.longitude')} THEN c.latitude
             WHEN {SQL_GOOD.format('fix.latitude')} THEN fix.latitude END AS latitude,
        CASE WHEN {SQL_GOOD.format('c.latitude')} AND {SQL_GOOD.format('c.longitude')} THEN c.longitude ELSE fix.longitude END AS longitude
    FROM c LEFT JOIN fix ON lower(trim(c.city_name)) = city AND lower(trim(c.province_ext)) = prov
""")
def coordinate_repair(spark, sf):
    raw = raw_cities(spark, sf).toDF(
        "unique_identifier", "city_name", "province", "province_ext", "region", "zip", "latitude", "longitude")
    cities = raw.select("unique_identifier", F.trim("city_name").alias("city_name"), "province_ext", "latitude", "longitude")
    known = read_table(spark, sf, "supplier").join(
        read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit(" City_"), F.floor(F.col("s_suppkey") / 2).cast("string"), F.lit(" ")).alias("city_name"),
        F.col("n_name").alias("province_ext"),
        F.when(F.col("s_acctbal") > 5000, F.lit("44.25")).otherwise(F.lit("unknown")).alias("latitude"),
        F.lit("11.5").alias("longitude"))
    return extraction.repair_coordinates(cities, known)


@query("haversine_radius", """
    WITH c AS (SELECT c_custkey, 36 + (c_custkey * 37 % 1100) / 100.0::DOUBLE AS lat, 6 + (c_custkey * 53 % 1250) / 100.0::DOUBLE AS lon FROM customer),
    d AS (SELECT c_custkey, 2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians(lat) - radians(44.5)) / 2), 2)
            + cos(radians(44.5)) * cos(radians(lat)) * power(sin((radians(lon) - radians(11.34)) / 2), 2)))) AS km FROM c)
    SELECT c_custkey, round(km, 6) AS distance_km FROM d WHERE km <= 250
""")
def haversine_radius(spark, sf):
    key = F.col("c_custkey")
    c = read_table(spark, sf, "customer").select(
        "c_custkey", (36 + (key * 37 % 1100) / 100).alias("lat"), (6 + (key * 53 % 1250) / 100).alias("lon"))
    km = geo.haversine(F.lit(44.5), F.lit(11.34), F.col("lat"), F.col("lon"))
    return c.select("c_custkey", km.alias("km")).where("km <= 250").select("c_custkey", F.round("km", 6).alias("distance_km"))


# --- incremental runs ---------------------------------------------------------------

# The earlier snapshot holds the labelled documents; low-quality ones had another
# text and toxic ones none.
SQL_PREVIOUS = """
    SELECT doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN text || ' (old)' ELSE text END AS description_raw,
        CAST(-1 AS INTEGER) AS n_words, TIMESTAMP '2024-01-01' AS time_processing
    FROM documents JOIN labels USING (doc_id)"""
SQL_DETECTED = f"""
    SELECT d.doc_id, d.text, p.n_words, p.time_processing,
        coalesce(p.description_raw IS NULL OR (d.text <> p.description_raw AND p.description_raw <> 'Description'), true) AS needs_processing
    FROM documents d LEFT JOIN ({SQL_PREVIOUS}) p ON d.doc_id = p.doc_id WHERE trim(d.text) <> ''"""


def snapshots(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    new = docs.select("doc_id", F.col("text").alias("description"), F.col("text").alias("description_raw"), F.lit(None).cast("string").alias("jobtitle"))
    old_text = F.when(F.col("toxic") == 1, F.lit(None)).when(
        F.col("quality") == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    previous = docs.join(read_table(spark, sf, "labels"), "doc_id").select(
        "doc_id", old_text.alias("description_raw"), F.lit(-1).alias("n_words"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("time_processing"))
    return new, previous


@query("change_detection", f"SELECT doc_id, needs_processing, n_words FROM ({SQL_DETECTED})")
def change_detection(spark, sf):
    return incremental.detect_vacancies(*snapshots(spark, sf), key="doc_id").select("doc_id", "needs_processing", "n_words")


def merged(spark, sf):
    new, previous = snapshots(spark, sf)
    detected = incremental.detect_vacancies(new, previous, key="doc_id")
    count_words = lambda rows: rows.withColumn("n_words", F.size(text.tokens(F.col("description"))))
    return incremental.reprocess(
        detected, "needs_processing", count_words, ["n_words"], F.lit("2024-02-01").cast("timestamp_ntz"))


@query("incremental_merge", rf"""
    SELECT doc_id, needs_processing, CASE WHEN needs_processing THEN CAST(len(list_filter(
            regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS INTEGER) ELSE n_words END AS n_words,
        CASE WHEN needs_processing THEN TIMESTAMP '2024-02-01' ELSE time_processing END AS time_processing
    FROM ({SQL_DETECTED})
""")
def incremental_merge(spark, sf):
    return merged(spark, sf).select("doc_id", "needs_processing", "n_words", "time_processing")


@query("run_log", f"""
    SELECT count(*) FILTER (WHERE needs_processing) AS nproc_rows, TIMESTAMP '2024-02-01' AS processed_at FROM ({SQL_DETECTED})
""")
def run_log(spark, sf):
    detected = incremental.detect_vacancies(*snapshots(spark, sf), key="doc_id")
    return incremental.run_counts(detected, F.lit("2024-02-01").cast("timestamp_ntz"), nproc_rows="needs_processing")
