"""Ranked search on the driver tables."""

from pyspark.sql import functions as F

from matchspark.functions.filters import compile_filter
from matchspark.operators import blockmax, search
from matchspark.plans.registry import query
from matchspark.sources.tables import read_table, spread, staged

TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query("search_build", r"""
    SELECT p_partkey, p_size, p_brand, 'P name: ' || p_name || chr(10) || 'P type: ' || coalesce(nullif(p_type, 'PROMO'), '') AS description
    FROM part
""")
def search_build(spark, sf):
    p = read_table(spark, sf, "part").withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))
    return search.build_documents(p, "p_partkey", {"p_name": "P name", "p_type": "P type"}, ["p_size", "p_brand"], [])


@query("search_meta", """
    SELECT role, column_name, position, filled FROM (
        SELECT count(p_name) AS a, count(nullif(p_type, 'PROMO')) AS b, count(p_size) AS c FROM part) n,
        LATERAL (VALUES ('search', 'p_name', 0, n.a), ('search', 'p_type', 1, n.b), ('attribute', 'p_size', 0, n.c),
            ('output', 'p_name', 0, n.a)) AS t(role, column_name, position, filled)
""")
def search_meta(spark, sf):
    p = read_table(spark, sf, "part").withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))
    return search.index_description(p, ["p_name", "p_type"], ["p_size"], ["p_name"])


PICK = """
    SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {0}) WHERE rank <= 5"""


def sql_search(queries: str, where: str = "", pick: str = "") -> str:
    return f"""
    WITH p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY ALL),
    l AS (SELECT doc_id, len({TOKENS.format('text')}) AS doc_len FROM documents),
    n AS (SELECT count(*) AS docs, avg(doc_len) AS mean_len FROM l),
    q AS (SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS token FROM {queries})),
    f AS (SELECT token, count(*) AS df FROM p WHERE token IN (SELECT token FROM q) GROUP BY token),
    s AS (SELECT item_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2
            / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))) AS score
          FROM q JOIN f USING (token) JOIN p USING (token) JOIN l USING (doc_id) CROSS JOIN n
          {where} GROUP BY item_id, doc_id){pick or PICK.format('s')}"""


def _ranked(found):
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("search_topk", sql_search("benchmark"))
def search_topk(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    items = read_table(spark, sf, "benchmark")
    return _ranked(search.search(docs, "doc_id", "text", items, "item_id", "text"))


FILTER = {"@and": [{"@lte": {"n_chars": 3000}}, {"@eq": {"lang": "en"}}]}


@query("search_filtered", sql_search(
    "benchmark",
    "WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars <= 3000 AND lang = 'en')"))
def search_filtered(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text", "n_chars", "lang"))
    items = read_table(spark, sf, "benchmark")
    return _ranked(search.search(docs, "doc_id", "text", items, "item_id", "text", FILTER))


@query("search_stored_index", sql_search("benchmark"))
def search_stored_index(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    index = staged(blockmax.block_index(docs, "doc_id", "text"), "index")
    items = read_table(spark, sf, "benchmark")
    return _ranked(search.search(docs, "doc_id", "text", items, "item_id", "text", index=index))


# Every document with a word of the item or, where the item has a vector, with a vector.
SQL_BLENDED = """, e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    v AS (
        SELECT i.item_id, t.doc_id, 10 * list_dot_product(d.e, q.e)
            / (sqrt(list_dot_product(d.e, d.e)) * sqrt(list_dot_product(q.e, q.e)) + 1e-9) AS score
        FROM benchmark i JOIN e q ON q.vec_id = i.item_id CROSS JOIN (documents t JOIN e d ON d.vec_id = t.doc_id)),
    b AS (
        SELECT item_id, doc_id, coalesce(s.score, 0) + coalesce(v.score, 0) AS score
        FROM s FULL JOIN v USING (item_id, doc_id))"""


@query("search_blended", sql_search("benchmark", pick=SQL_BLENDED + PICK.format("b")))
def search_blended(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    vectors = read_table(spark, sf, "embeddings")
    return _ranked(search.search(docs, "doc_id", "text", read_table(spark, sf, "benchmark"), "item_id", "text", vectors=(
        vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("doc_vector")),
        vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector")), 10.0)))


@query("structured_filter", """
    SELECT doc_id, lang, n_chars FROM documents
    WHERE (n_chars <= 800 AND (lang = 'en' OR source = 'src1')) AND NOT (n_chars >= 600 AND lang = 'fr')
""")
def structured_filter(spark, sf):
    predicate = compile_filter({"@and": [
        {"@lte": {"n_chars": 800}}, {"@or": [{"@eq": {"lang": "en"}}, {"@eq": {"source": "src1"}}]},
        {"@not": {"@and": [{"@gte": {"n_chars": 600}}, {"@eq": {"lang": "fr"}}]}}]})
    return read_table(spark, sf, "documents").where(predicate).select("doc_id", "lang", "n_chars")
