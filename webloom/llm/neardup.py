"""Operator 4: near-duplicates by banded MinHash with odd sketches.

Words are ASCII lower-cased; a document's set holds the distinct runs of
``shingle`` words (with fewer words, the whole sequence as one element;
without words it is empty). Documents whose sets have a Jaccard similarity
of ``similarity`` percent or more are linked, and components follow.

1. Per document: size and digest of its set, ``BANDS`` band keys of
   ``ROWS`` MinHash samples, and the odd sketch: every sample toggles one
   bit of a bitmap, so the bits set in the XOR of two sketches count the
   samples in which two documents differ, precisely so for similar ones.
2. Rows with equal sets are one class; its first row stands for it.
3. Within a band bucket every class is compared with three of them,
   the smallest ones in the fixed ``ORDERS`` (stars, linear in the bucket's
   size). Sizes and sketches must allow the similarity; then the full sets
   are intersected.
4. Buckets whose members are now one component are done. In the others the
   members outside of the largest component are compared with all members
   of other components, by sketch and then on full sets, in blocks of
   ``BLOCK``; only links leave the tasks. So no pair that shares a bucket
   goes untested, and a large group of mutual copies costs stars and the
   few that fall outside, not all its pairs.

At 80 % a pair shares no bucket with probability (1 - 0.8**5)**40 = 1e-7.
Sketch estimates below similarity by six standard errors are cut.

Rows are told apart by themselves, not by id: a row is numbered when its
sketch is written, a class when the classes are, and texts are found again
by a digest of id and whole text. The first row of a component (smallest id,
rows without an id last, then by that digest) is the one kept, and its id
names the component: null where no row has one. So rows repeated under one
id with other texts are judged by their texts, and of equal rows one is
kept. Null and empty texts have the empty set, are linked with nothing and
stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from .base import add_columns, release, stage
from .graph import components
from .textvec import lower_ascii, mix, ngram_hashes, powers, slices, text_buffer, word_hashes, words

ROWS, BANDS = 5, 40
SAMPLES = ROWS * BANDS
SKETCH_BITS = 1024
BLOCK = 256
DEALS = 16              # parts of a large component's members
ORDERS = (0, 0x2AAAAAAAAAAAAAAA, 0x1999999999999999)     # XOR masks of ids: in each order the smallest is a centre

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2 ** 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2 ** 63, SAMPLES, dtype=np.uint64)


def shingle_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text."""
    data, offsets = text_buffer(col)
    out: list[np.ndarray] = []
    for lo, hi in slices(offsets):
        own = offsets[lo: hi + 1]
        raw = lower_ascii(data[own[0]: own[-1]])
        starts, ends, counts = words(raw, own - own[0])
        h = word_hashes(raw, starts, ends)
        grams, _ = ngram_hashes(h, counts, n)
        at = np.cumsum(counts) - counts
        for a, c in zip(at.tolist(), counts.tolist()):
            if c >= n:
                out.append(np.unique(grams[a: a + c - n + 1]))
            elif c:
                out.append(mix((h[a: a + c] * powers(c)).sum(keepdims=True) + np.uint64(c)))
            else:
                out.append(grams[:0])
    return out


def samples(g: np.ndarray) -> np.ndarray:
    """MinHash samples of one set."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(g), 512):
        part = _A[:, None] * g[None, i: i + 512]
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def sketch(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch words) of the samples."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for k, p in enumerate(powers(ROWS + 1)[1:]):
        keys = keys + mix(low.reshape(BANDS, ROWS)[:, k]) * p
    bit = (mix(low ^ (np.arange(SAMPLES, dtype=np.uint64) * _B[0])) >> np.uint64(64 - 10)).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return mix(keys).view(np.int64), np.packbits(odd).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _digest(doc_id: str, text: str) -> Column:
    """128 bits of a row's id and whole text."""
    own, body = F.col(doc_id).cast("long").cast("string"), F.col(text).cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(own, F.lit("")), F.lit(":"), F.coalesce(body, F.lit(""))).cast("binary")))


def sketched(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, key, n, k1, k2, bands, odd) of every row; key digests id and text, (k1, k2) the set."""
    def fn(col):
        sets = shingle_sets(col, shingle)
        k1 = np.array([mix(g).sum(dtype=np.uint64) for g in sets], np.uint64)
        k2 = np.array([mix(g ^ _B[1]).sum(dtype=np.uint64) for g in sets], np.uint64)
        parts = [sketch(samples(g)) if len(g) else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for g in sets]
        return [pa.array([len(g) for g in sets], pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                _lists([p[0] for p in parts]), _lists([p[1] for p in parts])]

    src = docs.select(F.col(doc_id).cast("long").alias("id"), _digest(doc_id, text).alias("key"), F.col(text).alias("text"))
    return add_columns(src, "n long, k1 long, k2 long, bands array<long>, odd array<long>", fn, keep=["id", "key"])


def _differing(similarity: int) -> int:
    """XOR bits that two sketches of that similarity exceed once in 1e9 times."""
    j = similarity / 100
    cut = min(SAMPLES, SAMPLES * (1 - j) + 6.2 * math.sqrt(SAMPLES * j * (1 - j)) + 1)
    return int(SKETCH_BITS / 2 * (1 - math.exp(-2 * 2 * cut / SKETCH_BITS))) + 6


def _alike(a: str, b: str, similarity: int) -> Column:
    """Sizes and sketches of sides a and b allow the similarity."""
    words_ = SKETCH_BITS // 64
    bits = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(words_)), F.lit(0))
    size = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * similarity
    return size & (bits <= _differing(similarity))


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    both = np.searchsorted(a, b)
    same = int((a[np.minimum(both, len(a) - 1)] == b).sum())
    return same * 100 >= (len(a) + len(b) - same) * similarity


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar."""
    left, right = sets.select(F.col("rep").alias("u"), F.col("s").alias("x")), sets.select(F.col("rep").alias("v"), F.col("s").alias("y"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i) for i in (2, 3))
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity)
                    for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


def _rest(named: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (u, v) between different components that share a bucket.

    In every bucket with several components the members outside of its
    largest one (outsiders) are compared with all members of other
    components, on full sets. Outsiders are dealt out in blocks of BLOCK by
    that largest component; a block's task holds the block and streams the
    members of its buckets past it, each once however many buckets they
    share."""
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("m"))
    split = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("k")) \
        .where("k > 1").select("key", F.col("top.component").alias("largest"))
    inside = stage(named.join(split, "key"), "split")
    outsiders = inside.where("component <> largest").select("rep", "component", "largest").distinct()
    blocks = outsiders.groupBy("largest").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = stage(outsiders.join(blocks, "largest").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
                  .drop("blocks"), "outsiders")
    present = inside.where("component <> largest").join(dealt.select("rep", "largest", "block"), ["rep", "largest"]) \
        .select("key", "largest", "block").distinct()
    members = inside.select("key", "rep", "component").join(present, "key").select("largest", "block", "rep", "component").distinct()
    rows = dealt.withColumn("role", F.lit(0)).unionByName(members.withColumn("role", F.lit(1))) \
        .join(sets.select("rep", "odd", "bands", "s"), "rep")
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "largest", "block").sortWithinPartitions("largest", "block", "role") \
        .select("largest", "block", "role", "rep", "component", "odd", "bands", "s")
    limit = _differing(similarity)

    def run(batches):
        at, own, linked, packed = None, [], set(), None
        for batch in batches:
            links = []
            cols = [batch.column(i).to_pylist() for i in range(5)]
            odd, bands = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (5, 6))
            for i, (largest, block, role, rep, component) in enumerate(zip(*cols)):
                if (largest, block) != at:
                    at, own, linked, packed = (largest, block), [], set(), None
                s = np.frombuffer(batch.column(7)[i].as_buffer(), np.uint64)
                if role == 0:
                    own.append((rep, component, odd[i].copy(), bands[i].copy(), s.copy()))
                    continue
                if packed is None:
                    packed = np.array([o[2] for o in own]), np.array([o[3] for o in own]), np.array([o[1] for o in own]), \
                        np.array([len(o[4]) for o in own])
                near = (np.bitwise_count(packed[0] ^ odd[i]).sum(axis=1, dtype=np.int64) <= limit) & (packed[2] != component)
                near &= np.minimum(packed[3], len(s)) * 100 >= np.maximum(packed[3], len(s)) * similarity
                for j in np.flatnonzero(near).tolist():
                    if (own[j][0], component) not in linked and (packed[1][j] == bands[i]).any() and _similar(own[j][4], s, similarity):
                        linked.add((own[j][0], component))        # one link joins the components
                        links.append((own[j][0], rep))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _judged(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: int) -> DataFrame:
    """(id, key, n, component_id, kept) of every row."""
    spark = docs.sparkSession
    configure(spark)
    drawn = stage(sketched(docs, doc_id, text, shingle).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = drawn.where("n > 0")
    first = F.struct(F.col("id").isNull().alias("last"), "id", "key", "row")
    classes = stage(some.withColumn("first", first).groupBy("k1", "k2", "n").agg(
        F.min("first").alias("first"), F.min_by(F.struct("bands", "odd"), "first").alias("x"))
        .select("first", "k1", "k2", "n", "x.bands", "x.odd").withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    turned = [F.col("rep").bitwiseXOR(F.lit(o)) for o in ORDERS]       # undone by the same operation
    centres = buckets.groupBy("key").agg(*[F.min(x).alias(f"c{i}") for i, x in enumerate(turned)],
                                         F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    centres = centres.select("key", F.array(*[F.col(f"c{i}").bitwiseXOR(F.lit(o)) for i, o in enumerate(ORDERS)]).alias("centres"))
    members = stage(buckets.join(centres, "key"), "members")

    # full sets of the classes that have company
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("first.key", "rep", "n", "bands", "odd")
    src = docs.select(_digest(doc_id, text).alias("key"), F.col(text).alias("text")) \
        .join(wanted.select("key").hint("shuffle_merge"), "key", "left_semi")      # alike at every size
    spelled = add_columns(src, "s binary", lambda col: [pa.array([g.tobytes() for g in shingle_sets(col, shingle)], pa.binary())],
                          keep=["key"]).dropDuplicates(["key"])
    sets = stage(wanted.join(spelled, "key").select("rep", "n", "bands", "odd", "s"), "sets")

    info = sets.select("rep", "n", "odd")
    star = members.select(F.col("rep").alias("u"), F.explode(F.array_distinct("centres")).alias("v")).where("u <> v") \
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    star = (star.join(info.alias("a"), F.col("u") == F.col("a.rep")).join(info.alias("b"), F.col("v") == F.col("b.rep"))
            .where(_alike("a", "b", similarity)).select("u", "v"))
    edges = stage(_confirmed(star, sets, similarity), "links")
    label = components(edges)
    named = stage(members.select("key", "rep").join(label, F.col("rep") == F.col("node"), "left")
                  .select("key", "rep", F.coalesce("component", "rep").alias("component")), "named")
    more = stage(_rest(named, sets, similarity), "more")
    release(members, sets, named)
    if not more.isEmpty():
        label = components(edges.unionByName(more))

    # the first row of every component, dealt out for large ones
    linked = label.join(classes.select("rep", "first"), F.col("node") == F.col("rep")).select("node", "component", "first")
    top = linked.groupBy("component").agg(F.min("first").alias("top")) \
        .withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    led = label.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(DEALS)).cast("int")).join(top, ["component", "deal"]) \
        .select("node", "top")
    final = classes.join(led, F.col("rep") == F.col("node"), "left") \
        .select("k1", "k2", "n", F.coalesce("top", "first").alias("top"))
    judged = some.select("id", "key", "n", "k1", "k2", "row").join(final, ["k1", "k2", "n"]) \
        .select("id", "key", "n", F.col("top.id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("kept"))
    alone = drawn.where("n = 0").select("id", "key", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return judged.unionByName(alone)


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 2,
               similarity: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest id reachable), kept (the one row that stands for its component)."""
    return _judged(docs, doc_id, text, shingle, similarity) \
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                 similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component. Of rows with equal
    id and text that differ elsewhere, the first by their JSON."""
    judged = _judged(docs, doc_id, text, shingle, similarity).where("n > 0")
    marked = stage(judged.groupBy(F.col("key").alias("__key")).agg(F.max("kept").alias("__kept"), F.count("*").alias("rows"))
                   .where("NOT __kept OR rows > 1").select("__key", "__kept"), "gone")
    keyed = docs.withColumn("__key", _digest(doc_id, text))
    left = keyed.join(marked, "__key", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = marked.where("__kept")
    if again.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = keyed.join(again, "__key", "left_semi").select("__key", row.alias("row")) \
        .groupBy("__key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.unionByName(one.select("row.*"))
