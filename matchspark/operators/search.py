"""Ranked text search: search document, postings, filters, top results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions.filters import compile_filter
from matchspark.functions.once import let
from matchspark.functions.text import tokens
from matchspark.operators import blockmax
from matchspark.operators.skew import SMALL_ROWS
from matchspark.sources.tables import staged

def search_document(columns: dict[str, str]) -> Column:
    """A line 'label: value' for each column of a column -> label map; unknown values leave the label."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(""))) for c, label in columns.items()])


def build_documents(df: DataFrame, key: str, searched: dict[str, str], attributes: list[str], output: list[str]) -> DataFrame:
    kept = list(dict.fromkeys([key, *attributes, *output]))
    return df.select(*kept, search_document(searched).alias("description"))


def index_description(df: DataFrame, searched: list[str], attributes: list[str], output: list[str]) -> DataFrame:
    """What an index holds: (role, column_name, position, filled), filled being the
    number of rows with a value."""
    listed = [(role, name, i) for role, names in
              (("search", searched), ("attribute", attributes), ("output", output)) for i, name in enumerate(names)]
    counted = df.agg(*[F.count(name).alias(f"n{i}") for i, (_, name, _) in enumerate(listed)])
    rows = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(name).alias("column_name"),
                 F.lit(position).alias("position"), F.col(f"n{i}").alias("filled"))
        for i, (role, name, position) in enumerate(listed)])
    return counted.select(F.inline(rows))


def postings(docs: DataFrame, key: str, text: str, tasks: int | None = None) -> DataFrame:
    """(key, token, tf, doc_len): one row per distinct token of a document, counted where the
    document lies after one hash partitioning by key. With a number of tasks the texts are
    partitioned, which are several times smaller than the rows of their words."""
    def rows(words: Column) -> Column:
        size = F.size(words)
        return F.transform(words, lambda w: F.struct(w.alias("token"), size.alias("doc_len")))

    if tasks:
        docs = docs.select(key, text).repartition(tasks, F.col(key))
    each = docs.select(key, F.inline(let(tokens(F.col(text)), rows)))
    return (each if tasks else each.repartition(F.col(key))).groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc_len) of every document; stored beside its postings."""
    return docs.select(key, F.size(tokens(F.col(text))).alias("doc_len"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    return queries.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def search(
    docs: DataFrame, doc_key: str, text: str, queries: DataFrame, query_key: str, query_text: str,
    filter_object: dict | None = None, limit: int = vocab.SEARCH_LIMIT,
    index: DataFrame | tuple[DataFrame, DataFrame] | None = None,
    vectors: tuple[DataFrame, DataFrame, float] | None = None,
) -> DataFrame:
    """Best documents per query by BM25: (query, document, score, rank).

    With vectors, (document, doc_vector), (query, query_vector) and a weight, the score is
    BM25 + weight * cosine over every document that has a word of the query or a vector;
    a missing vector counts as cosine 0. Document counts and lengths are those of the whole
    index; the filter only restricts results. Keys are unique.

    index holds stored postings, in blocks (blockmax.block_index) or as rows (postings and
    lengths); without it documents are tokenised once, and the postings of the words that
    queries use are written in blocks. Most documents are never scored (see blockmax).
    """
    terms = query_terms(queries, query_key, query_text)
    if index is None:
        # Sent to the tasks when counted to be few; all words are indexed otherwise.
        words = [r[0] for r in terms.select("token").limit(SMALL_ROWS + 1).collect()]
        index = staged(blockmax.block_index(docs, doc_key, text, list(set(words)) if len(words) <= SMALL_ROWS else None), "postings")
    elif isinstance(index, tuple):
        words = terms.select("token").distinct()
        index = staged(blockmax.index_of_postings(index[0].join(words, "token", "left_semi"), index[1], doc_key), "postings")
    size = blockmax.totals(index).first()  # one row
    idf = F.log(1 + (F.lit(size["docs"] or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(blockmax.frequencies(index), "token").groupBy(query_key).agg(
        F.collect_list(F.struct("token", idf.alias("idf"))).alias("terms"))
    asked = weighted.withColumn("vector", F.lit(None).cast("array<float>"))
    doc_vectors, weight = None, 0.0
    if vectors is not None:
        doc_vectors, query_vectors, weight = vectors
        asked = (
            queries.select(query_key).distinct().join(weighted, query_key, "left")
            .join(query_vectors.select(query_key, F.col("query_vector").alias("vector")), query_key, "left"))
    allowed = docs.where(compile_filter(filter_object)).select(doc_key) if filter_object else None
    found = blockmax.best_documents(
        index, asked, terms, queries.count(), size["mean_len"] or 1.0, limit, doc_key, query_key, weight, doc_vectors, allowed)
    return _ranked(found, doc_key, query_key, limit)


def _ranked(scored: DataFrame, doc_key: str, query_key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.round("score", 9).desc(), F.col(doc_key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
