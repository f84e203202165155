"""Skew-safe row numbers equal a window's, also when one group holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stagecraft.operators.ranking import row_numbers


def _window(df, by, order):
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def test_matches_window_with_hot_group(spark):
    # group 0 holds ~90% of 20,000 rows; others are small; some keys are null
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 97).otherwise(F.lit(0)).alias("g"),
        F.when(F.col("id") == 5, F.lit(None)).otherwise(F.col("id") % 7).alias("k"),
        (F.col("id") * 7919 % 20011).alias("o"))
    got = row_numbers(df, ["g"], ["o"], "rn")
    assert got.select("g", "o", "rn").exceptAll(_window(df, ["g"], ["o"]).select("g", "o", "rn")).count() == 0
    two = row_numbers(df, ["g", "k"], ["o"], "rn")
    assert two.select("g", "k", "o", "rn").exceptAll(_window(df, ["g", "k"], ["o"]).select("g", "k", "o", "rn")).count() == 0
    assert got.filter("g = 0").agg(F.max("rn")).first()[0] == df.filter("g = 0").count()


def test_empty_input(spark):
    df = spark.createDataFrame([], "g int, o int")
    assert row_numbers(df, ["g"], ["o"]).count() == 0


def test_null_group_is_numbered_once(spark):
    from pyspark.sql import functions as F
    from stagecraft.operators.ranking import row_numbers
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.lit("\u0000null")).alias("g"), "id")
    got = row_numbers(df.repartition(8), ["g"], ["id"]).collect()
    for g, n in ((None, 3000), ("\u0000null", 1000)):
        assert sorted(r.rn for r in got if r.g == g) == list(range(1, n + 1))
