"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir), docs being the previous one's output as written,
and returns the columns of documents; the last returns the packed pieces. Each is judged
on its own input: copies are those among what the stage before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm import exact_dedup, packing, quality_qda, secret_scan, simhash_ring
from matchspark.llm.common import staged
from matchspark.sources.tables import read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects (score below 0.3) go."""
    return quality_qda.keep_good(docs, read_table(spark, sf_dir, "labels"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash_ring.keep_first(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, with its length made anew."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return packing.packed_documents(docs, packing.default_file())


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", no_exact_copies),
    ("simhash near-dedup", no_near_copies),
    ("secret scans", no_secrets),
    ("best-fit packing", packed),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's output written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
