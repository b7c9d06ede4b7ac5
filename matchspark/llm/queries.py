"""The operators as named queries over the driver tables, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchspark.llm import (
    bpe_fst,
    exact_dedup,
    html_cut,
    license_scan,
    packing,
    periodic_runs,
    quality_qda,
    run_length_index,
    secret_scan,
    simhash_ring,
    source_divergence,
    suffix_trees,
    va_topk,
)
from matchspark.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


VA_TOPK_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op1_va_file_topk", VA_TOPK_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return va_topk.nearest(read_table(spark, folder, "embeddings"))


@query("op2_simhash_pigeonring")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_ring.near_digests(read_table(spark, folder, "documents"))


@query("op3_suffix_tree_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_trees.removed_digests(read_table(spark, folder, "documents"))


@query("op4_secret_ownership", secret_scan.SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_digests(read_table(spark, folder, "documents"))


@query("op5_vector_best_fit")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, folder, "documents"), packing.default_file())


@query("op6_license_dice", license_scan.sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.notices(read_table(spark, folder, "documents"))


@query("op7_quality_qda")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality_qda.scored(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op8_run_length_index")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return run_length_index.removed_digests(read_table(spark, folder, "documents"))


EXACT_DEDUP_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM n JOIN g USING (body)
"""


@query("op9_exact_dedup", EXACT_DEDUP_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, folder, "documents"))


@query("op10_bpe_transducer")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = bpe_fst.default_files()
    return bpe_fst.coded_digests(read_table(spark, folder, "documents"), ranks, pattern)


@query("op11_html_min_cut")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return html_cut.extracted(read_table(spark, folder, "pages"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(read_table(spark, folder, "documents"))


@query("op13_source_divergence", source_divergence.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergences(read_table(spark, folder, "documents"))
