"""Reading tables, and sinks that never overwrite what a plan still reads."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from matchspark.session import shared_folder

CITY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("unique_identifier", "city_name", "province", "province_ext", "region", "zip")]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude")]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that would keep at most half the cores busy.

    A small file of one row group is one task, however heavy the expressions on
    it. Large inputs already split by row group and are left without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 <= cores:
        return df.repartition(cores)
    return df


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: what is used several times is
    made once, and a lost executor's part is read again instead of being made again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in a repeatable order: by a hash of the key, then the key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns, order and types of another frame; absent columns become typed nulls."""
    have = {c.lower() for c in df.columns}
    return df.select([
        (F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


# How a header is spelled as a column name.
HEADER = str.maketrans({" ": "_", '"': None, "'": None})


def named_by_headers(df: DataFrame) -> DataFrame:
    """Columns named by their headers in lower case, without quotes, blanks as underscores."""
    return df.toDF(*(c.strip().lower().translate(HEADER) for c in df.columns))


def load_cities(raw: DataFrame) -> DataFrame:
    """City dimension from any tabular source: headers, zip padding, numbers, blank names."""
    df = named_by_headers(raw)
    texts = [f.name for f in CITY_SCHEMA if f.name not in ("zip", "latitude", "longitude")]

    def number(name: str) -> Column:
        value = F.col(name).cast("string").try_cast("double")
        return F.when(~F.isnan(value), value)

    zip_digits = F.col("zip").cast("string").try_cast("double").try_cast("long").cast("string")
    name = F.lower(F.trim(F.col("city_name").cast("string")))
    return (
        df.where(name.isNotNull() & (name != "") & ~name.isin("null", "nan"))
        .select(
            *[F.trim(F.col(c).cast("string")).alias(c) for c in texts],
            # Padded, never cut: codes of other countries may be longer.
            F.when(F.length(zip_digits) < 5, F.lpad(zip_digits, 5, "0")).otherwise(zip_digits).alias("zip"),
            number("latitude").alias("latitude"),
            number("longitude").alias("longitude"),
        )
        .select(CITY_SCHEMA.fieldNames())
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a previous run published something at this path.

    Only an absent path counts as absent: any other failure is raised, for a table taken
    for new would lose its history.
    """
    try:
        return not spark.read.parquet(f"{path}/_current").isEmpty()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def _newest(spark: SparkSession, path: str):
    return spark.read.schema("version string, at long").parquet(f"{path}/_current").orderBy(F.desc("at"), "version").first()


def publish(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones, then point readers at it.

    Pointers are only added, one row each, and the newest counts; a run that dies at any
    point leaves the last published version in place.
    """
    spark, version = df.sparkSession, f"v={uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    before = _newest(spark, path)["at"] if table_exists(spark, path) else 0
    pointer = spark.createDataFrame([(version, max(time.time_ns(), before + 1))], "version string, at long")
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/_current")
    return f"{path}/{version}"


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_newest(spark, path)['version']}")


def append_log(counts: DataFrame, path: str, run_id: str) -> None:
    """One row of counts per run; a run repeated under the same id replaces its own row."""
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run_id}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with a surrogate id in run order."""
    log = spark.read.parquet(path)
    return log.selectExpr("row_number() over (order by processed_at, run) as id", "*")


def reset_log(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Keyed lookup of one row; stays a frame, so nothing is collected."""
    return df.where(F.col(key) == F.lit(value)).limit(1)
