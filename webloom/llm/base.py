"""Shared plumbing of the operators: Arrow maps over a text column."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure, fresh_dir


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(docs: DataFrame, schema: str, fn: Callable[[pa.Array], list], text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus the columns of ``schema`` that ``fn`` computes from one
    Arrow batch of texts. A new column replaces an input column of its name;
    ``keep`` restricts the input columns that are carried along."""
    configure(docs.sparkSession)
    new = T.StructType.fromDDL(schema)
    names = new.fieldNames()
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("__text"))
    out = T.StructType([src.schema[c] for c in kept] + new.fields)

    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in range(len(kept))] + list(fn(b.column(len(kept))))
            yield pa.RecordBatch.from_arrays(cols, names=kept + names)

    return src.mapInArrow(run, out)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back:
    cuts the lineage, and a lost executor costs no recomputation."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
