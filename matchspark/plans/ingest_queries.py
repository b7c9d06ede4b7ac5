"""Scans, recency, notes and text cleaning on the driver tables."""

from pyspark.sql import functions as F

from matchspark.functions import text
from matchspark.operators import cleaning, notes, recency
from matchspark.plans.registry import query
from matchspark.sources.tables import read_table, sample_rows, spread

AS_OF = "2001-08-01"


def ntz(value: str):
    return F.lit(value).cast("timestamp_ntz")


@query("scan_project", """
    SELECT doc_id, lang, source, 'Italia' AS country, CAST(NULL AS VARCHAR) AS processed_by
    FROM documents
    WHERE (trim(text) <> '' OR trim(source) <> '') AND length(text) >= 180
""")
def scan_project(spark, sf):
    d = read_table(spark, sf, "documents")
    kept = (text.not_blank(F.col("text")) | text.not_blank(F.col("source"))) & (F.length("text") >= 180)
    return d.where(kept).select(
        "doc_id", "lang", "source", F.lit("Italia").alias("country"), F.lit(None).cast("string").alias("processed_by"))


@query("sample_n", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000
""")
def sample_n(spark, sf):
    return sample_rows(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 1000)


@query("latest_version", """
    SELECT event_id, user_id, event_type, value, props FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
        FROM events)
    WHERE rn = 1 AND event_type <> 'error' AND props ILIKE '%K%'
""")
def latest_version(spark, sf):
    e = read_table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    latest = notes.latest_version(e, ["user_id", "day"], ["ts", "event_id"])
    return latest.where((F.col("event_type") != "error") & F.col("props").ilike("%K%")).select(
        "event_id", "user_id", "event_type", "value", "props")


@query("activity_recency", f"""
    WITH latest AS (
        SELECT o_custkey, max(o_orderdate) AS last_change FROM orders
        WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY o_custkey),
    people AS (
        SELECT *, TIMESTAMP '{AS_OF}' - to_days(CAST(c_acctbal / 10 AS INTEGER)) AS date_added FROM customer)
    SELECT c_custkey, c_name, date_added, greatest(date_added, last_change) AS date_last_active
    FROM people LEFT JOIN latest ON c_custkey = o_custkey
    WHERE date_added >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY OR last_change IS NOT NULL
""")
def activity_recency(spark, sf):
    added = ntz(AS_OF) - F.make_dt_interval(F.round(F.col("c_acctbal") / 10).cast("int"))
    people = read_table(spark, sf, "customer").select("c_custkey", "c_name", added.alias("date_added"))
    orders = read_table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    return recency.recent(people, orders, "c_custkey", "o_orderdate", ["date_added"], ntz(AS_OF), 30, "o_custkey")


@query("open_vacancy_recency", f"""
    WITH latest AS (
        SELECT l_orderkey, max(l_shipdate) AS last_change FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY GROUP BY l_orderkey)
    SELECT o_orderkey, o_orderdate, o_orderpriority, greatest(o_orderdate, last_change) AS date_last_active
    FROM orders LEFT JOIN latest ON o_orderkey = l_orderkey
    WHERE o_orderstatus = 'O'
      AND (o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY OR last_change IS NOT NULL)
""")
def open_vacancy_recency(spark, sf):
    openings = read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "O").select(
        "o_orderkey", "o_orderdate", "o_orderpriority")
    changes = read_table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    return recency.recent(openings, changes, "o_orderkey", "l_shipdate", ["o_orderdate"], ntz(AS_OF), 60, "l_orderkey")


@query("date_range_scan", """
    SELECT event_id, ts, event_type FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'
""")
def date_range_scan(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "ts", "event_type")
    return recency.between_dates(e, "ts", ntz("2024-01-05"), ntz("2024-01-12"))


@query("retention_filter", """
    SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY
""")
def retention_filter(spark, sf):
    return recency.retain(read_table(spark, sf, "events").select("event_id", "ts", "user_id"), "ts", ntz("2024-01-30"), 10)


@query("high_water_increment", """
    SELECT event_id, ts, value FROM events
    WHERE ts >= (SELECT coalesce(max(ts), TIMESTAMP '1900-01-01') FROM events WHERE ts < TIMESTAMP '2024-01-20')
""")
def high_water_increment(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "ts", "value")
    return recency.since_high_water(e, e.where(F.col("ts") < ntz("2024-01-20")), "ts")


@query("chat_thread", """
    WITH chats AS (
        SELECT conv_id, string_agg(text, ' || ' ORDER BY turn, text) AS chatwa FROM conversations
        WHERE role ILIKE '%USER%' AND text ILIKE '%on%' GROUP BY conv_id)
    SELECT c_custkey AS candidateid, c_name, chatwa FROM customer LEFT JOIN chats ON c_custkey = conv_id
""")
def chat_thread(spark, sf):
    lines = read_table(spark, sf, "conversations").where(
        F.col("role").ilike("%USER%") & F.col("text").ilike("%on%")).withColumnRenamed("conv_id", "candidateid")
    chats = notes.threads(lines, "candidateid", "text", ["turn", "text"], F.floor(F.col("turn") / 16), "chatwa")
    people = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("candidateid"), "c_name")
    return notes.with_threads(people, chats)


# --- text ---------------------------------------------------------------------

# The noise pattern as stated for an engine that does not backtrack.
PLAIN_NOISE = (
    "/9j/[A-Za-z0-9+/=]{30,}|iVBORw0KGgo[A-Za-z0-9+/=]{30,}|JVBERi0x[A-Za-z0-9+/=]{30,}"
    "|[A-Za-z0-9+/=]{80,}|[^A-Za-z0-9 ]{30,}|([A-Za-z]{3,} ){15,}"
)


def sql_noise(c: str) -> str:
    return f"regexp_replace({c}, '{PLAIN_NOISE}', '', 'g')"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{text.BLANK_CLASS}+|{text.BLANK_CLASS}+$', '', 'g')"


def sql_html(c: str) -> str:
    blocks = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "template"))
    out = f"regexp_replace({c}, '(?is){blocks}', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    out = f"regexp_replace({out}, '<[!?][^>]*>', '', 'g')"
    out = f"""regexp_replace({out}, '</?[A-Za-z]([^>"'']+|"[^"]*"|''[^'']*'')*>', '', 'g')"""
    for name, char in text.ENTITIES.items():
        quoted = char.replace("'", "''")
        out = f"replace({out}, '&{name};', '{quoted}')"
    return out


@query("clean_noise", f"SELECT doc_id, {sql_noise('text')} AS cleaned FROM documents")
def clean_noise(spark, sf):
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", text.remove_noise(F.col("text")).alias("cleaned"))


@query("clean_html", f"SELECT page_id, {sql_html('html')} AS visible FROM pages")
def clean_html(spark, sf):
    p = spread(read_table(spark, sf, "pages").select("page_id", "html"))
    return p.select("page_id", text.strip_html(F.col("html")).alias("visible"))


@query("clean_description", f"""
    WITH t AS (
        SELECT 'd' || doc_id AS id, text AS description FROM documents
        UNION ALL SELECT 'p' || page_id, html FROM pages),
    n AS (SELECT id, {sql_noise('description')} AS description FROM t),
    s AS (SELECT id, {sql_strip("regexp_replace(description, '[ \t]+', ' ', 'g')")} AS description
          FROM n WHERE trim(description) <> ''),
    h AS (SELECT id, lower({sql_html('description')}) AS description FROM s)
    SELECT id, description FROM h
    WHERE length(trim(description)) > 5 AND NOT contains(description, 'null')
""")
def clean_description(spark, sf):
    d = read_table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("description"))
    p = read_table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("description"))
    return cleaning.clean_texts(spread(d).unionByName(spread(p)))


@query("length_cap", """
    SELECT doc_id, CASE WHEN length(text) > 20000 THEN '' ELSE text END AS text FROM documents
""")
def length_cap(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", text.cap_length(F.col("text"), 20_000).alias("text"))


@query("whitelist_text", f"""
    SELECT doc_id, coalesce(regexp_replace(regexp_replace(trim(text), '{text.BLANK_CLASS}+', ' ', 'g'),
        '{text.DROPPED_CHARS.replace("'", "''")}', '', 'g'), '') AS kept
    FROM documents
""")
def whitelist_text(spark, sf):
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", text.keep_latin(F.col("text")).alias("kept"))
