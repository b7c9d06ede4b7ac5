from pyspark.sql import functions as F

from matchspark.operators import profiling, skew


def test_join_weighted_keeps_every_row(spark):
    big = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    side = big.groupBy("k").agg(F.count("*").alias("w"), F.max("v").alias("top"))
    got = skew.join_weighted(big, side, ["k"], "w")
    assert got.columns == ["k", "v", "top"] and got.count() == 30_000
    assert got.select("v").distinct().count() == 30_000
    assert got.exceptAll(big.join(side.drop("w"), "k")).count() == 0


def test_hot_pair_is_not_shuffled_with_the_rest(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit(0)).otherwise(F.col("id")).alias("x"), F.lit(1).alias("y"), "id")
    rows.write.parquet(str(tmp_path / "t"))
    got = profiling.pair_counts(spark.read.parquet(str(tmp_path / "t")), "x", "y")
    assert got.where("x = 0").agg(F.min("pair_count"), F.count("*")).first()[:] == (4000, 4000)
    assert got.where("x > 0").agg(F.max("pair_count"), F.count("*")).first()[:] == (1, 1000)


def test_small_is_counted(spark):
    marked = skew.small(spark.range(5), 5)._jdf.queryExecution().analyzed().toString()
    left = skew.small(spark.range(6), 5)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in marked and "ResolvedHint" not in left
