"""The stored state of monitored pages, in buckets of their key.

One row per (monitor_id, url). Rows lie in ``buckets`` folders by a hash of the
key, and every upsert writes the buckets that it touches as a new version;
all other buckets, with their texts, are neither read nor written. A small
manifest names the version of each bucket. It is renamed into place when the
new files are complete, so a reader sees the state before or after an upsert
and a run that breaks off changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import monitor as M
from . import folders

BUCKETS = 512       # about 200 GB a bucket at 100 TB of state; a parameter of a new store
KEYS = ["monitor_id", "url"]


class MonitorState:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        names = folders.names(spark, f"{self.path}/manifest")
        last = names and folders.get_json(spark, f"{self.path}/manifest/{names[-1]}")
        self.version, self.buckets, self.at = (last["version"], last["buckets"], last["at"]) if last else (0, buckets, {})

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")

    def _rows(self, at: dict) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], schemas.MONITOR_PAGES)
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.schema(schemas.MONITOR_PAGES).parquet(*paths)

    def read(self) -> DataFrame:
        """The whole state."""
        return self._rows(self.at)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the given keys (at most ``buckets`` numbers)."""
        return sorted(r.b for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def near(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the buckets that the given keys lie in."""
        return self._rows({str(b): self.at[str(b)] for b in self.touched(keys) if str(b) in self.at})

    def replace(self, rows: DataFrame, touched: list[int]) -> "MonitorState":
        """Makes ``rows`` the content of the buckets ``touched``."""
        if not touched:
            return self
        version = self.version + 1
        folders.delete(self.spark, f"{self.path}/version={version}")      # of a run that broke off
        rows.select(*[f.split()[0] for f in schemas.MONITOR_PAGES.split(", ")]).withColumn("bucket", self.bucket()) \
            .repartitionByRange("bucket", *KEYS).sortWithinPartitions("bucket", *KEYS) \
            .write.partitionBy("bucket").parquet(f"{self.path}/version={version}")
        written = {n.split("=")[1] for n in folders.names(self.spark, f"{self.path}/version={version}") if n.startswith("bucket=")}
        at = {b: v for b, v in self.at.items() if int(b) not in set(touched)} | {b: version for b in written}
        folders.put_json(self.spark, f"{self.path}/manifest/{version:010d}.json", {"version": version, "buckets": self.buckets, "at": at})
        self.version, self.at = version, at
        return self

    def upsert(self, cur: DataFrame) -> "MonitorState":
        """M10 on the store: fetched pages replace their rows."""
        fetched = cur.where("http_status = 200")
        touched = self.touched(fetched)
        return self.replace(M.upsert_monitor_pages(self._rows({str(b): self.at[str(b)] for b in touched if str(b) in self.at}), cur), touched)

    def forget(self, versions: int = 2) -> None:
        """Deletes files that none of the newest ``versions`` manifests names."""
        names = folders.names(self.spark, f"{self.path}/manifest")
        held = {(b, v) for n in names[-versions:] for b, v in folders.get_json(self.spark, f"{self.path}/manifest/{n}")["at"].items()}
        for v in (n for n in folders.names(self.spark, self.path) if n.startswith("version=")):
            if int(v.split("=")[1]) <= self.version:
                for b in (n for n in folders.names(self.spark, f"{self.path}/{v}") if n.startswith("bucket=")):
                    if (b.split("=")[1], int(v.split("=")[1])) not in held:
                        folders.delete(self.spark, f"{self.path}/{v}/{b}")
        folders.delete(self.spark, *[f"{self.path}/manifest/{n}" for n in names[:-versions]])
