"""Operator 10: document fingerprints, bottom-k sketches of word shingles.

A text's shingles are its runs of five words (ASCII lower-cased); with one
to four words, all of them as one shingle; without words there are none.
The fingerprint holds the ``K`` smallest distinct 48-bit shingle hashes in
ascending order, 8 base64 characters each: the empty text has the empty
fingerprint, equal texts have equal ones, and fingerprints of parts merge
into that of the union. Null texts count as empty.

``resemblance`` of two fingerprints is the share of the K smallest hashes
of their union that both hold (exact below K shingles); two empty ones
resemble each other fully, an empty and another one not at all.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from .base import add_columns
from .textvec import lower_ascii, mix, ngram_hashes, powers, slices, text_buffer, word_hashes, words

K = 128
SHINGLE = 5
BITS = 48


def sketches(col: pa.Array, k: int = K) -> list[np.ndarray]:
    """Ascending distinct smallest shingle hashes of every text."""
    data, offsets = text_buffer(col)
    out: list[np.ndarray] = []
    for lo, hi in slices(offsets):
        own = offsets[lo: hi + 1]
        raw = lower_ascii(data[own[0]: own[-1]])
        starts, ends, counts = words(raw, own - own[0])
        h = word_hashes(raw, starts, ends)
        grams, _ = ngram_hashes(h, counts, SHINGLE)
        at = np.cumsum(counts) - counts
        for a, n in zip(at.tolist(), counts.tolist()):
            if n >= SHINGLE:
                g = grams[a: a + n - SHINGLE + 1]
            elif n:
                g = mix((h[a: a + n] * powers(n)).sum(keepdims=True) + np.uint64(n))
            else:
                g = grams[:0]
            g = g >> np.uint64(64 - BITS)
            if len(g) > 4 * k:      # the k-th distinct value is among the smallest ones, unless these repeat
                small = np.unique(np.partition(g, 2 * k)[: 2 * k])
                g = small if len(small) >= k else g
            out.append(np.unique(g)[:k])
    return out


def pack(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).copy().view(">u8").ravel().astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)[:k]
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has, from resemblance and set sizes."""
    na, nb = distinct(a, k), distinct(b, k)
    if not na:
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (na + nb) / na)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1] + np.uint64(1)) / 2.0 ** BITS)


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``fingerprint string`` and ``n_shingles double`` (estimated)."""
    def fn(col):
        got = sketches(col)
        return [pa.array(map(pack, got), pa.string()), pa.array(map(distinct, got), pa.float64())]
    return add_columns(docs, "fingerprint string, n_shingles double", fn, text, keep)


def merge(prints: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint) of the union of all texts of a key: the k smallest
    of all hashes, picked before and after the shuffle, so that a key with
    many rows stays cheap. Keys with only empty fingerprints get an empty one."""
    parts = prints.select(F.col(key).alias("key"), F.col(fingerprint).alias("f"))
    each = parts.select("key", F.explode_outer(F.expr(
        "transform(sequence(1, greatest(1, length(f) div 8)), i -> substring(f, (i - 1) * 8 + 1, 8))")).alias("h")) \
        .select("key", F.hex(F.unbase64("h")).alias("h")).distinct()
    low = each.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("h").asc_nulls_last())))
    return low.where(f"n <= {int(k)}").groupBy("key").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("h")), lambda h: F.base64(F.unhex(h))), "").alias("fingerprint")) \
        .withColumnRenamed("key", key)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds <= key (null: 0), as a balanced tree of tests."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))
    return tree(0, len(bounds))


def edit_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is
    replaced by the start of the next document's.

    Documents follow each other by descending id (null ids last, equal ids
    by text); the last one is followed by the first. The rows are dealt out
    in id ranges, each with one row more, the first of the range after it,
    and streamed in order; so every text is shuffled once and no task needs
    more than a batch. Ids are long; one id held by very many rows stays in
    one range.
    """
    spark = docs.sparkSession
    configure(spark)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = src.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).head()[0]
    bounds = sorted(set(marks or []))
    ranged = src.withColumn("part", _bucket(F.col("doc_id"), bounds))
    # at most one row per range
    first = {r.part: r.head for r in ranged.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(first, reverse=True)
    after = [(first[nxt], at) for at, nxt in zip(order, order[1:] + order[:1])]
    heads = spark.createDataFrame(after or [(None, 0)], "head long, part int")
    extra = src.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "part", F.lit(1).alias("extra"))
    rows = ranged.withColumn("extra", F.lit(0)).unionByName(extra)
    if not order:
        rows = rows.limit(0)
    rows = rows.repartitionByRange(parts, "part") \
        .sortWithinPartitions(F.desc("part"), "extra", F.col("doc_id").desc_nulls_last(), "text")
    schema = T.StructType.fromDDL("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double")

    def run(batches):
        held = None                       # the last row, still without its next one
        for b in batches:
            got = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                           b.column(3).to_pylist(), sketches(b.column(1))))
            line = ([held] if held else []) + got
            pairs = [(x, y) for x, y in zip(line, line[1:]) if not x[3] and x[2] == y[2]]
            if line:
                held = line[-1]
            if not pairs:
                continue
            edited = [x[1][: len(x[1]) - len(x[1]) // 3] + y[1][: len(x[1]) // 3] for x, y in pairs]
            other = sketches(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x, _ in pairs], pa.int64()),
                pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([pack(x[4]) for x, _ in pairs], pa.string()),
                pa.array([pack(e) for e in other], pa.string()),
                pa.array([resemblance(x[4], e) for (x, _), e in zip(pairs, other)], pa.float64()),
                pa.array([resemblance(x[4], y[4]) for x, y in pairs], pa.float64()),
            ], names=schema.fieldNames())

    return rows.select("doc_id", "text", "part", "extra").mapInArrow(run, schema)
