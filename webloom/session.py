"""Spark session and shared-storage helpers.

Only settings that change semantics are forced here (UTC session time
zone, ANSI off for lenient casts). Sizing knobs such as shuffle
partitions are left to the cluster configuration; the local defaults
below apply only when a value is not already set.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Largest per-key rank limit the operators use (3 * max max_pages).
WINDOW_LIMIT = 3000
ARROW_BATCH_ROWS = 500

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML rows are large: keep Arrow batches small so a Python worker
    # never holds more than a few MB of pages at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def get_spark(master: str | None = None, app: str = "webloom",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", os.environ.get("WEBLOOM_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``webloom`` importable in Python workers (pandas UDFs, stateful
    streaming functions): zip the package once per SparkContext and add it
    with ``addPyFile``, which distributes it to every executor."""
    sc = spark.sparkContext
    key = sc.applicationId   # unique per SparkContext
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="webloom-code-"), "webloom.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def configure(spark: SparkSession) -> None:
    """Pin the semantic settings every operator relies on, plus the
    threshold that lets per-job ``row_number() <= k`` filters (k up to the
    3 x 1000 discovery cap) run as a partial top-k before the shuffle."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(WINDOW_LIMIT))
    # Arrow batches of HTML rows: bound what one Python worker holds (the
    # default 10,000 pages can be hundreds of MB); keep a smaller setting.
    cur = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if cur > ARROW_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object
    store) location and is used as is; a cluster session without it is an
    error, never a machine-local folder. Only a local-mode session (tests)
    gets a private folder under the system temp dir when it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")
        d = tempfile.mkdtemp(prefix="webloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new, never-reused sub folder of the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{tag}-{uuid.uuid4().hex[:12]}"
