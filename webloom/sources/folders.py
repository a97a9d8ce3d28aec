"""Small files and folders of the shared storage, by the cluster's own file system."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes one small JSON file; it appears whole or not at all."""
    fs, p = _at(spark, path + ".tmp")
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    _, final = _at(spark, path)
    if not fs.rename(p, final):
        raise OSError(f"could not write {path}")


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names of what lies in a folder; none if there is no folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def sizes(spark: SparkSession, folder: str) -> list[int]:
    """Bytes of the data files that lie in a folder."""
    fs, p = _at(spark, folder)
    return [s.getLen() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))]


def get_json(spark: SparkSession, path: str) -> dict:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def get_jsons(spark: SparkSession, folder: str) -> list[dict]:
    """All JSON files of a folder (a bounded number of small ones), by name."""
    return [get_json(spark, f"{folder}/{n}") for n in names(spark, folder) if n.endswith(".json")]


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _at(spark, path)
        fs.delete(p, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts the folder ``new`` in the place of ``path``."""
    fs, p = _at(spark, path)
    _, q = _at(spark, new)
    fs.delete(p, True)
    if not fs.rename(q, p):
        raise OSError(f"could not replace {path}")
