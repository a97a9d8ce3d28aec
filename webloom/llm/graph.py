"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import release, stage

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v),
    for every node of an edge.

    Large-star and small-star steps by turns: each node hands its larger
    neighbours, then its smaller ones, to the smallest of them, until every
    node hangs on the smallest of its component. Minima are aggregates, so
    no neighbourhood is gathered; every round is written to the shared
    folder. The number of rounds grows with the logarithm of the diameter.
    """
    now = stage(_directed(edges), "edges")
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(_directed(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = stage(_directed(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .unionByName(least.select("u", F.col("m").alias("v")))), "small")
        release(large)
        if nxt.exceptAll(now).isEmpty() and now.exceptAll(nxt).isEmpty():
            roots = nxt.select(F.col("v").alias("node")).distinct()
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")) \
                .unionByName(roots.withColumn("component", F.col("node")))
        release(now)
        now = nxt
    raise RuntimeError("components did not settle")


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
