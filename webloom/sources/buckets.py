"""Parquet tables in hash buckets of their key.

A bucketed table is read with the partitioning that it was written in, so
a join or aggregation on its key moves only the other side. ``BucketTable``
appends rows without touching what is stored, and ``attach`` opens the
files again in another session. The catalog entry is external and named by
the path; dropping it leaves the files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, int(buckets)
        self.name = "webloom_" + hashlib.md5(self.path.encode()).hexdigest()

    def append(self, rows: DataFrame) -> "BucketTable":
        """Adds rows: one task and file a bucket, each sorted by the key."""
        (rows.repartition(self.buckets, *self.keys).write.format("parquet").mode("append").option("path", self.path)
         .bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name))
        return self

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def attach(self, schema: str) -> "BucketTable":
        """Registers the files that are already under the path."""
        keys = ", ".join(self.keys)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self

    def detach(self) -> DataFrame:
        """Drops the catalog entry; the rows as a plain table of files."""
        schema = self.read().schema
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)
