"""Operator 2: benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over ``SPAN`` consecutive tokens: tokens at
its 1 positions are hashed, those at its 0 positions are ignored, so a
window still hits when tokens were substituted at ignored positions. Test
items are hashed under every mask at every position, training texts
likewise; equal hashes of one mask join. A hit aligns a text with an item
at one diagonal; an overlap is verified around it: within the item's
extent there must be a stretch of ``need`` aligned tokens (the whole item
if it is shorter, see ``MIN_OVERLAP``) of which the share ``SIMILARITY`` or
more is equal. Tokens are ASCII lower-cased words.

Items with fewer words than ``SPAN`` are hashed whole, by an unspaced hash
of all their words, and must occur exactly.

The test side is taken in blocks of at most ``BLOCK_HASHES`` hashes that
are shipped to the tasks (the size is counted first, so what is shipped is
bounded however large the benchmark is); every block is joined with all
training rows. Null or empty texts and items overlap with nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from .textvec import lower_ascii, mix, powers, slices, text_buffer, word_hashes, words

# Fixed masks over 8 tokens, 5 of which are hashed; together they tolerate
# any one and most pairs of substitutions within a window.
MASKS = ("11111000", "11101010", "11010011", "10110101")
SPAN = 8
MIN_OVERLAP = 13      # aligned tokens that make an overlap, or the whole item if it has fewer
SIMILARITY = 0.8
BLOCK_WORDS = 200_000     # test tokens shipped to the tasks at once (about 10 MB with their hashes)

OVERLAP = "doc_id long, item_id long, text_start int, item_start int, n_words int, n_equal int"


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of len(mask) words under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(len(mask), np.uint64(0xA0761D6478BD642F))):
        if mask[k] == "1":
            out += h[k: k + n] * p
    return mix(out + np.uint64(int(mask, 2)))


class Items:
    """Seed table of one block of test items: word hashes of each item and,
    per mask, sorted seed hashes with their (item, position)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        data, off = text_buffer(pa.array([t for _, t in items], pa.string()))
        raw = lower_ascii(data)
        s, e, n = words(raw, off)
        h = word_hashes(raw, s, e)
        at = np.cumsum(n) - n
        self.words = [h[a: a + c] for a, c in zip(at, n)]
        self.seeds = []
        for mask in MASKS:
            self.seeds.append(self.table([(seed_hashes(w, mask), i) for i, w in enumerate(self.words) if len(w) >= SPAN]))
        short: dict[int, list] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) < SPAN:
                short.setdefault(len(w), []).append((seed_hashes(w, "1" * len(w)), i))
        self.short = {n: self.table(rows) for n, rows in short.items()}

    @staticmethod
    def table(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(r[0]), r[1], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(r[0])) for r in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        bloom = np.zeros(1 << 20, bool)      # most windows hit nothing: one look-up tells
        bloom[(keys >> np.uint64(44)).astype(np.int64)] = True
        return keys, item[order], pos[order], bloom

    @staticmethod
    def hits(hashes: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, position in item) of all equal hashes."""
        keys, item, pos, bloom = table
        at = np.flatnonzero(bloom[(hashes >> np.uint64(44)).astype(np.int64)]) if len(keys) else np.zeros(0, np.int64)
        lo = np.searchsorted(keys, hashes[at], "left")
        n = np.searchsorted(keys, hashes[at], "right") - lo
        pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), item[pick], pos[pick]

    def overlaps(self, h: np.ndarray, first: np.ndarray, last: np.ndarray, hashes_of) -> list[tuple]:
        """Verified (word position of the text, item, start in text, start in
        item, aligned, equal), one per diagonal. ``first``/``last``: word
        range of the text that holds each word position."""
        found = set()
        for table, mask in [*zip(self.seeds, MASKS), *((t, "1" * n) for n, t in self.short.items())]:
            if not len(table[0]):
                continue
            at, item, pos = self.hits(hashes_of(mask), table)
            ok = at + len(mask) <= last[at]
            found.update(zip(first[at[ok]].tolist(), item[ok].tolist(), (at[ok] - pos[ok]).tolist()))
        end = dict(zip(first.tolist(), last.tolist())) if found else {}
        out = []
        for begin, item, diagonal in sorted(found):
            w = self.words[item]
            need = min(MIN_OVERLAP, len(w))
            share = SIMILARITY if len(w) >= SPAN else 1.0
            a, b = max(begin, diagonal), min(end[begin], diagonal + len(w))
            if b - a < need:
                continue
            same = h[a:b] == w[a - diagonal: b - diagonal]
            total = np.concatenate([[0], np.cumsum(same)])
            windows = total[need:] - total[:-need]
            good = np.flatnonzero(windows >= share * need - 1e-9)
            if len(good):
                x, y = int(good[0]), int(good[-1]) + need
                out.append((begin, item, a + x - begin, a + x - diagonal, y - x, int(total[y] - total[x])))
        return out


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """Blocks of test items, at most BLOCK_WORDS words each (or one item).
    Items are streamed partition by partition, never gathered at once."""
    src = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")) \
        .where(F.col("t").isNotNull()).distinct()
    block, size = [], 0
    for r in src.toLocalIterator():
        n = len(r.t.split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield block


_ITEMS: dict[str, Items] = {}


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per verified overlap: doc_id, item_id, word starts in text and
    item, aligned and equal words. Rows of one document are found together;
    identical rows of ``docs`` give identical overlaps."""
    spark = docs.sparkSession
    configure(spark)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType.fromDDL(OVERLAP)
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        found = _against(spark, src, block, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


class Shipped:
    """A block of items on its way to the tasks; each worker builds its
    tables once."""

    def __init__(self, spark, block: list[tuple[int, str]]):
        self.shared, self.key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def overlaps(self, col: pa.Array) -> list[tuple]:
        """(row of the batch, item id, ...) of all verified overlaps."""
        if self.key not in _ITEMS:
            if len(_ITEMS) > 3:
                _ITEMS.clear()
            _ITEMS[self.key] = Items(self.shared.value)
        items = _ITEMS[self.key]
        data, offsets = text_buffer(col)
        out = []
        for lo, hi in slices(offsets):
            own = offsets[lo: hi + 1]
            raw = lower_ascii(data[own[0]: own[-1]])
            s, e, n = words(raw, own - own[0])
            if not len(s):
                continue
            h = word_hashes(raw, s, e)
            stop = np.cumsum(n)
            first, last = np.repeat(stop - n, n), np.repeat(stop, n)
            row = {int(x): lo + i for i, (x, c) in enumerate(zip(stop - n, n)) if c}
            out += [(row[begin], items.ids[item], *rest) for begin, item, *rest
                    in items.overlaps(h, first, last, lambda m, h=h: seed_hashes(h, m))]
        return out


def _against(spark, src: DataFrame, block: list[tuple[int, str]], schema: T.StructType) -> DataFrame:
    shipped = Shipped(spark, block)

    def run(batches):
        for b in batches:
            found = shipped.overlaps(b.column(1))
            cols = [b.column(0).take(pa.array([r[0] for r in found], pa.int64()))]
            cols += [pa.array([r[i] for r in found], pa.int64() if i == 1 else pa.int32()) for i in range(1, 6)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per document that overlaps with the benchmark: doc_id, its
    items (ascending, at most the benchmark's), overlaps and equal words."""
    found = overlaps(docs, benchmark, **names).distinct()
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"),
                                       F.count("*").alias("n_overlaps"), F.sum("n_equal").alias("n_equal"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a verified overlap. Decided row by row,
    so null or repeated ids do no harm; all columns stay."""
    spark = docs.sparkSession
    configure(spark)
    for block in _blocks(benchmark, item_id, item_text):
        docs = _without(spark, docs, block, text)
    return docs


def _without(spark, docs: DataFrame, block: list[tuple[int, str]], text: str) -> DataFrame:
    shipped, at = Shipped(spark, block), docs.columns.index(text)

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in shipped.overlaps(b.column(at))]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
