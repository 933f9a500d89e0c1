"""Tables of long loops."""

from pyspark.sql import functions as F

from graphloom.storage import materialise


def estimate(df):
    return int(df._jdf.queryExecution().analyzed().stats().sizeInBytes()).bit_length()


def test_estimates_stay_numbers_of_ordinary_size(spark):
    """A loop that joins a table to one made from it; unbounded, its estimate would have over a thousand bits by now."""
    df = materialise(spark.range(8).withColumn("v", F.col("id") + 1))
    for _ in range(8):
        df = materialise(df.join(df.select("id", F.col("v").alias("m")), "id").select("id", (F.col("m") + 1).alias("v")))
        assert estimate(df) <= 64
    assert sorted(map(tuple, df.collect())) == [(i, i + 9) for i in range(8)]
