"""Table sinks: K1 page rows and K2 scrape log (K3-K5 payloads and text are
built in their operator modules; these two are the appending fact tables).

Both are appends partitioned by date, so retention (Q17) drops whole
partitions; rows are clustered by key inside each file so parquet
min/max statistics let per-job lookups (Q1, Q4) skip row groups. The range
partitioning cuts a day with many rows into as many tasks as it needs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import folders
from .ops import retain_logs


def write_job_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """K1: append job_pages rows, partitioned by scrape date, sorted by
    (job_id, ord) within each file."""
    out = pages.withColumn("scraped_date", F.to_date("scraped_at"))
    out.repartitionByRange("scraped_date", "job_id", "ord").sortWithinPartitions("scraped_date", "job_id", "ord") \
       .write.mode(mode).partitionBy("scraped_date").parquet(path)


def write_scrape_log(rows: DataFrame, path: str, mode: str = "append") -> None:
    """K2: append scrape_requests rows, partitioned by creation date."""
    out = rows.withColumn("created_date", F.to_date("created_at"))
    out.repartitionByRange("created_date", "created_at").sortWithinPartitions("created_date", "created_at") \
       .write.mode(mode).partitionBy("created_date").parquet(path)


def read_dated(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log of ``write_scrape_log``, with its partition column ``created_date``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("created_date", T.DateType())])).parquet(path)


def drop_expired(spark: SparkSession, path: str, as_of: str, days: int = 30, schema: T.StructType | None = None) -> list[str]:
    """Q17 on a stored log: removes the folders of all days before the
    cutoff's and writes that day anew without its expired rows. Days after
    it are not read. Rows without a creation time stay. Returns the removed
    days."""
    cutoff = dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)
    dated = {n: n.split("=")[1] for n in folders.names(spark, path) if n.startswith("created_date=") and not n.endswith("__")}
    old = [n for n, d in dated.items() if dt.date.fromisoformat(d) < cutoff.date()]
    folders.delete(spark, *[f"{path}/{n}" for n in old])
    edge = f"created_date={cutoff.date()}"
    if edge in dated:
        rows = spark.read.schema(schema).parquet(f"{path}/{edge}") if schema else spark.read.parquet(f"{path}/{edge}")
        if not rows.where(~F.coalesce(F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz"), F.lit(True))).isEmpty():
            retain_logs(rows, as_of, days).write.parquet(f"{path}/_{edge}.new")        # hidden from readers until it is whole
            folders.replace(spark, f"{path}/_{edge}.new", f"{path}/{edge}")
    return sorted(dated[n] for n in old)
