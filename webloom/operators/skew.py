"""Rank and lag over a key that may hold a large share of all rows.

``row_number()`` / ``lag()`` over ``partitionBy(key)`` send every row of a
key to one task; if one host owns a third of the data, that task sorts a
third of the data. These helpers compute the same values with a range
partitioning on (key, order...): the range sampler splits a hot key over
many partitions, each partition is ranked locally, and a small per
(key, partition) table supplies the offsets (rank) or the last row of the
preceding partition (lag). The partition index is read right after the
range exchange, so partitions are ordered like the keys. The ranged rows
are written once under the checkpoint root: the range sampler is seeded
per shuffle, so two recomputations could draw different bounds, and the
local ranks must agree with the per-partition table joined back to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_dir


def _ranged(df: DataFrame, key: str, order: list[str], parts: int | None) -> DataFrame:
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_dir(spark, "ranged")
    df.repartitionByRange(n, key, *order).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def row_number_within(df: DataFrame, key: str, order: list[str], out: str = "rn",
                      parts: int | None = None) -> DataFrame:
    """``row_number() over (partition by key order by order...)``, skew-safe.
    ``order`` must make rows unique within a key."""
    r = _ranged(df, key, order, parts)
    r = r.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", key).orderBy(*order)))
    cnt = r.groupBy(key, "_pid").agg(F.max("_local").alias("_n"))
    off = cnt.select(key, "_pid", F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return r.join(off, [key, "_pid"]).withColumn(out, (F.col("_off") + F.col("_local")).cast("long")) \
            .drop("_pid", "_local", "_off")


def lag_within(df: DataFrame, key: str, order: list[str], col: str, out: str,
               parts: int | None = None) -> DataFrame:
    """``lag(col) over (partition by key order by order...)``, skew-safe.
    ``order`` must make rows unique within a key."""
    r = _ranged(df, key, order, parts)
    w = Window.partitionBy("_pid", key).orderBy(*order)
    r = r.withColumn("_prev", F.lag(col).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = r.groupBy(key, "_pid").agg(F.max_by(col, F.struct(*order)).alias("_last"))
    carry = last.select(key, "_pid", F.lag("_last").over(Window.partitionBy(key).orderBy("_pid")).alias("_carry"))
    j = r.join(carry, [key, "_pid"])
    return j.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))) \
            .drop("_pid", "_prev", "_first", "_carry")
