"""Skew-safe rank / lag equal the plain window results with a hot key."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom.operators.skew import lag_within, row_number_within


def _data(spark):
    # key 'hot' holds ~70% of the rows
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % 5003).alias("t"), F.col("id").alias("id"))
    return df


def test_row_number_within_matches_window(spark):
    df = _data(spark)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    got = row_number_within(df, "k", ["t", "id"], parts=16)
    assert sorted(map(tuple, want.select("id", "rn").collect())) == sorted(map(tuple, got.select("id", "rn").collect()))


def test_lag_within_matches_window(spark):
    df = _data(spark)
    want = df.withColumn("p", F.lag("t").over(Window.partitionBy("k").orderBy("t", "id")))
    got = lag_within(df, "k", ["t", "id"], "t", "p", parts=16)
    assert sorted(map(tuple, want.select("id", "p").collect())) == sorted(map(tuple, got.select("id", "p").collect()))


def test_hot_key_is_split_over_partitions(spark):
    from webloom.operators.skew import _ranged
    r = _ranged(_data(spark), "k", ["t", "id"], 16)
    pids = {x._pid for x in r.where(F.col("k") == "hot").select("_pid").distinct().collect()}
    assert len(pids) >= 8
