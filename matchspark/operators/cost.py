"""Token and credit totals of a model study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark import vocab

CHARS_PER_TOKEN = 4


def token_count(c: Column) -> Column:
    """Estimated tokens: one per four characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(c) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("long")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.MODEL_PRICES, "model string, cost_in double, cost_out double")


def study_sample(df: DataFrame, text: str, key: str, n: int = 100) -> DataFrame:
    """Repeatable sample of rows with text, for a study."""
    return df.where(F.trim(text) != "").orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def with_tokens(df: DataFrame, prompt: Column, answer: Column) -> DataFrame:
    return df.withColumns({"tokens_in": token_count(prompt), "tokens_out": token_count(answer)}).withColumn(
        "tokens_total", F.col("tokens_in") + F.col("tokens_out"))


def row_credits(df: DataFrame, cost_in: float, cost_out: float) -> DataFrame:
    """Credits of every row for one model."""
    return df.withColumns({
        "credits_in": F.col("tokens_in") * F.lit(cost_in) / 1e6,
        "credits_out": F.col("tokens_out") * F.lit(cost_out) / 1e6,
    }).withColumn("credits_total", F.col("credits_in") + F.col("credits_out"))


def cost_by_model(df: DataFrame, price_rows: list[tuple[str, float, float]], group: str | None = None) -> DataFrame:
    """Totals per model (and group): tokens are summed once, then priced for every model."""
    sums = [F.count("*").alias("rows"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")]
    totals = df.groupBy(group).agg(*sums) if group else df.agg(*sums)
    models = F.array(*[F.struct(
        F.lit(m).alias("model"), F.lit(i).alias("cost_in"), F.lit(o).alias("cost_out")) for m, i, o in price_rows])
    priced = totals.withColumn("price", F.explode(models))
    keys = [group] if group else []
    return priced.select(
        *keys, F.col("price.model").alias("model"), "rows", "tokens_in", "tokens_out",
        (F.col("tokens_in") * F.col("price.cost_in") / 1e6).alias("credits_in"),
        (F.col("tokens_out") * F.col("price.cost_out") / 1e6).alias("credits_out"),
        ((F.col("tokens_in") * F.col("price.cost_in") + F.col("tokens_out") * F.col("price.cost_out")) / 1e6)
        .alias("credits_total"),
    )
