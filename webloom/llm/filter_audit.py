"""Operator 13: filter interaction audit over a table-driven byte transducer.

``measure`` reads every text's UTF-8 bytes once through a finite-state
transducer with two states (outside and inside a word). A byte's class and
the state select one entry of ``EMIT``: word start, word end, capital, code
point, symbol. The next state depends on the class alone, so a whole chunk
of bytes is looked up at once, and the last state is carried into the next
chunk. The word spans that it emits go into an open-addressing hash table
whose hits are verified byte by byte, which counts distinct words exactly.

``audit`` applies the five filters in all 120 orders. Which of them a
document fails does not depend on the order, so documents are counted by
(part, set of failed filters) and every order is read off those counts: at
most 32 rows a part, whatever the number of documents.

Null texts count as empty; so does a null part, which is the part "". Rows
are counted one by one, repeated ids and rows included. A row is a copy if
some smaller id has the same text; a null id is neither smaller nor larger
than another, so rows without id are never copies and have no labels. A
document has a label if any row of ``labels`` with its id gives it. An empty
table has no parts and no rows. Only the named columns are read, so further
columns, of whatever name, do not matter (``measure`` replaces columns of
its own five names).
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import add_columns
from .textvec import PIECE, mix, slices, text_buffer, word_hashes

# The filters' limits.
MIN_WORDS = 200
MIN_DISTINCT = 50        # per cent of words
MAX_CAPITALS = 3         # per cent of code points
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"

# Byte classes; END follows a text's last byte.
SPACE, UPPER, SYMBOL, LEAD, TAIL, END = range(6)
OUTSIDE, INSIDE = 0, 1
STARTS, ENDS, CAPITAL, POINT, MARK = 1, 2, 4, 8, 16

CLASS = np.full(256, LEAD, np.uint8)
CLASS[0x80:0xC0] = TAIL
CLASS[0x41:0x5B] = UPPER
CLASS[[ord(c) for c in SYMBOLS]] = SYMBOL
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE

NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE, OUTSIDE], np.uint8)
EMIT = np.array([
    # SPACE        UPPER                     SYMBOL                 LEAD            TAIL    END
    [POINT,        STARTS | POINT | CAPITAL, STARTS | POINT | MARK, STARTS | POINT, STARTS, 0],
    [POINT | ENDS, POINT | CAPITAL,          POINT | MARK,          POINT,          0,      ENDS],
], np.uint8)


def transduce(data: np.ndarray, offsets: np.ndarray, chunk: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts) of the texts data[offsets[i]: offsets[i + 1]]:
    byte spans of all words, and per text its capitals, code points and
    symbols. ``chunk`` bytes are looked up at once; a chunk may end anywhere."""
    counts = np.zeros((len(offsets) - 1, 3), np.int64)
    starts, ends, state = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], OUTSIDE
    for lo in range(0, max(len(data), 1), chunk):
        hi = min(lo + chunk, len(data))
        done = offsets[1:][(offsets[1:] > lo) & (offsets[1:] <= hi)] - lo        # texts that end in this chunk
        seen = np.insert(CLASS[data[lo:hi]], done, END)
        if not len(seen):
            break
        states = np.empty(len(seen), np.uint8)
        states[0] = state
        states[1:] = NEXT[seen[:-1]]
        state = NEXT[seen[-1]]
        out = EMIT.ravel()[states * np.uint8(EMIT.shape[1]) + seen]
        marks = np.flatnonzero(seen == END)
        for found, bit in ((starts, STARTS), (ends, ENDS)):
            at = np.flatnonzero(out & bit)
            found.append(at - np.searchsorted(marks, at) + lo)
        first, last = np.searchsorted(offsets[1:], lo, "right"), np.searchsorted(offsets[:-1], hi, "left")
        cut = np.clip(offsets[first: last + 1] - lo, 0, hi - lo)
        cut = cut + np.searchsorted(done, cut, "left")                            # the same places in ``seen``
        for k, bit in enumerate((CAPITAL, POINT, MARK)):
            total = np.concatenate([[0], np.cumsum((out & bit) != 0)])[cut]
            counts[first:last, k] += np.diff(total)
    return np.concatenate(starts), np.concatenate(ends), counts


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a: a + size] == data[b: b + size], for many spans of one byte at least."""
    out = np.ones(len(a), bool)
    total = np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PIECE, "right")))
        n = size[lo:hi]
        base = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(base, n)
        same = data[np.repeat(a[lo:hi], n) + at] == data[np.repeat(b[lo:hi], n) + at]
        out[lo:hi] = np.logical_and.reduceat(same, base)
        lo = hi
    return out


def first_occurrences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray,
                      hashes: np.ndarray | None = None) -> np.ndarray:
    """Whether a word is the first of its bytes in its text. All words probe
    one open-addressing table at once; an occupied slot counts as a hit only
    if text, length and bytes agree, else the word goes on to the next slot."""
    n = len(starts)
    first = np.zeros(n, bool)
    if not n:
        return first
    h = (word_hashes(data, starts, ends) if hashes is None else hashes) ^ mix(text.astype(np.uint64) + np.uint64(1))
    size = 1 << int(np.ceil(np.log2(4 * n)))
    table = np.full(size, -1, np.int64)
    slot = (h & np.uint64(size - 1)).astype(np.int64)
    lens = ends - starts
    left = np.arange(n)
    while len(left):
        at = slot[left]
        free = table[at] < 0
        table[at[free][::-1]] = left[free][::-1]             # the earliest word of a free slot gets it
        owner = table[at]
        same = owner == left
        first[left[same]] = True
        look = np.flatnonzero(~same & (text[owner] == text[left]) & (lens[owner] == lens[left]) & (h[owner] == h[left]))
        same[look] = _equal_bytes(data, starts[left[look]], starts[owner[look]], lens[left[look]])
        left = left[~same]
        slot[left] = (slot[left] + 1) & (size - 1)
    return first


def _measured(col: pa.Array) -> list[pa.Array]:
    data, offsets = text_buffer(col)
    got = np.zeros((len(offsets) - 1, 5), np.int64)
    for lo, hi in slices(offsets):
        own = offsets[lo: hi + 1] - offsets[lo]
        part = data[offsets[lo]: offsets[hi]]
        starts, ends, counts = transduce(part, own)
        text = np.searchsorted(own, starts, "right") - 1
        got[lo:hi, 0] = np.bincount(text, minlength=hi - lo)
        got[lo:hi, 1] = np.bincount(text[first_occurrences(part, starts, ends, text)], minlength=hi - lo)
        got[lo:hi, 2:] = counts
    return [pa.array(got[:, k]) for k in range(5)]


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus n_words, n_distinct, n_capitals, n_points and n_symbols."""
    return add_columns(docs, "n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long",
                       _measured, text, keep)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, failed): bit i of ``failed`` is set if the row
    fails filter i of A to D; ``digest`` identifies its text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                      F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text"))
    bad = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
           100 * F.col("n_capitals") > MAX_CAPITALS * F.col("n_points"), F.col("n_symbols") > 0]
    failed = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bad)), F.lit(0))
    return measure(src, keep=["doc_id", "part", "digest"]).select("doc_id", "part", "digest", failed.cast("int").alias("failed"))


def failure_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, failed, n, good, toxic): documents of a part by the set of all
    five filters that they fail, and how many of these are labelled.

    Copies are found without gathering a text's rows: rows are counted by
    (digest, part, labels, id), the smallest id of each of these groups is
    a minimum, and only one row a group meets the minimum over all parts.
    """
    known = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")) \
        .where("id is not null").groupBy("id").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    own = failures(docs, doc_id, text, part)
    # Rows without id meet no label; they are dealt out by their text.
    rows = own.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))) \
        .join(known.withColumn("deal", F.lit(0).cast("long")).withColumnRenamed("id", "doc_id"), ["doc_id", "deal"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    each = rows.groupBy("digest", "part", "failed", *flags, "doc_id").agg(F.count("*").alias("n"))
    groups = each.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))["n"].alias("n_least"))
    lowest = groups.groupBy(F.col("digest").alias("text")).agg(F.min("least").alias("lowest"))
    met = groups.join(lowest, F.col("digest") == F.col("text"))
    kept = F.col("n_null") + F.when(F.col("least") == F.col("lowest"), F.col("n_least")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("failed"), kept.alias("n")),
                              F.struct(F.col("failed").bitwiseOR(F.lit(1 << 4)).alias("failed"), (F.col("n") - kept).alias("n"))))
    label = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
    return met.select("part", "good", "toxic", split.alias("x")).groupBy("part", "x.failed") \
        .agg(F.sum("x.n").alias("n"), label("good"), label("toxic")).where("n > 0")


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``failure_counts``."""
    held = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("held"))   # 32 at most
    orders = F.lit(",".join("".join(p) for p in permutations(FILTERS)))
    rows = held.select("part", "held", F.explode(F.split(orders, ",")).alias("filter_order")) \
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda c: F.expr(f"shiftleft(1, locate({c}, '{FILTERS}') - 1)")
    rows = rows.withColumn("bit", bit_of("substring(filter_order, step, 1)")).withColumn("before", F.expr(
        f"aggregate(sequence(1, 5), 0, (m, i) -> if(i < step, m + shiftleft(1, locate(substring(filter_order, i, 1), '{FILTERS}') - 1), m))"))

    def total(value, when) -> Column:
        return F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + F.when(when(x), value(x)).otherwise(F.lit(0).cast("long")))

    n, bit, before = (lambda x: x["n"]), F.col("bit"), F.col("before")
    fails = lambda x: x["failed"].bitwiseAND(bit) != 0
    early = lambda x: x["failed"].bitwiseAND(before) != 0
    removed = lambda x: fails(x) & ~early(x)
    orders_first = lambda x: (F.lit(120) / F.bit_count(x["failed"])).cast("long")  # noqa: E731  orders in which one of the failed filters comes first
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda x: (x["failed"].bitwiseAND(bit.bitwiseOR(before)) == 0)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda x: fails(x) & early(x)).alias("redundant"),
        total(n, lambda x: x["failed"] == bit).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(lambda x: x["n"] * orders_first(x), fails).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each of the filters A to E keeps, removes and repeats, by part,
    order and step (see the module's text for odd rows)."""
    return interactions(failure_counts(docs, labels, doc_id, text, part))
