"""Exact repeats of fixed-length windows, shared by operators 5 and 8.

A window is ``size`` consecutive units (bytes or words) of one text. Which
windows occur more than once in the corpus is found without gathering all
windows anywhere:

* Parse. A rolling hash over ``gram`` units triggers: each window belongs to
  its smallest gram (the leftmost of equals), and consecutive windows with
  the same trigger form a phrase, which overlaps its neighbours so that
  every window lies in exactly one phrase. Equal windows have equal
  triggers, wherever they occur.
* Phrases whose trigger occurs once in the corpus hold no repeat.
* Dictionary. The others are counted by (trigger, content); what repeats
  as a whole is repeated in all its windows, and occurs once from here on.
* Order. Dictionary phrases are brought together by trigger and their
  windows sorted by content; equal neighbours are repeats. Of a trigger with
  more than ``HOT`` different phrases only hashes of windows travel: they
  are counted by aggregation and what repeats is joined back to the phrases.
* The verdicts go back to the phrases' occurrences and their texts.

Texts travel zstandard-compressed, once to be parsed; from then on only
those with a repeated trigger. Texts are told apart by (id, hash of text);
rows repeated under one id count as occurrences of their own and get equal
results. Contents are compared by 64-bit hashes within one 64-bit trigger.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from .base import add_columns, release, stage
from .textvec import BASE, mix, slices, text_buffer, word_hashes, words

HOT = 20_000            # different phrases of one trigger that a task brings together
DEALS = 16              # parts of a hot window's places
GATHER = 5_000         # phrases a task orders at a time, and those of their last trigger
PIECE = 1 << 19         # windows handled at a time (below the 2**20 positions a trigger value can tell)

_UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
_LOW = np.uint64((1 << 20) - 1)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C55))


class Scheme(NamedTuple):
    size: int           # units of a window
    gram: int           # units of a trigger
    words: bool         # units are words, else bytes


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        up, down = np.full(n, BASE), np.full(n, _UNBASE)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any run of units, from prefix sums."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(len(h) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:-1], dtype=np.uint64)])

    def runs(self, start: np.ndarray, n) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start])

    def all(self, n: int) -> np.ndarray:
        """The runs of n units at every position that has them."""
        k = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:k]) * self.down[:k]) if k > 0 else np.zeros(0, np.uint64)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: block-wise running minima from both sides."""
    n = len(v)
    pad = np.full(-n % w + w, np.iinfo(v.dtype).max, v.dtype)
    rows = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1: n])


def units(data: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every unit, units per text)."""
    if not scheme.words:
        return _BYTES[data], np.diff(offsets)
    s, e, n = words(data, offsets)
    return word_hashes(data, s, e), n


def phrases(h: np.ndarray, counts: np.ndarray, scheme: Scheme):
    """(text, first window, windows, trigger, content) of all phrases."""
    ends = np.cumsum(counts)
    out = []
    for lo in range(0, len(h) - scheme.size + 1, PIECE):
        part = h[lo: lo + PIECE + scheme.size - 1]
        roll = Rolling(part)
        grams = roll.all(scheme.gram)
        value = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        low = _sliding_min(value, scheme.size - scheme.gram + 1)
        text = np.searchsorted(ends, np.arange(lo, lo + len(low)), "right")
        valid = ends[text] - np.arange(lo, lo + len(low)) >= scheme.size
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new & valid)
        if not len(first):
            continue
        stop = np.append(np.flatnonzero(new | ~valid), len(low))
        n = stop[np.searchsorted(stop, first, "right")] - first
        at = (low[first] & _LOW).astype(np.int64)
        content = mix(roll.runs(first, n + scheme.size - 1) + (at - first).astype(np.uint64) * _BYTES[1]
                      + n.astype(np.uint64) * _BYTES[2])
        out.append((text[first], first + lo - (ends - counts)[text[first]], n, grams[at], content))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def _pack(texts: pa.Array) -> pa.Array:
    import zstandard
    press = zstandard.ZstdCompressor(level=3).compress
    return pa.array([press(t.as_buffer()) for t in texts.fill_null("").cast(pa.binary())], pa.binary())


def _unpack(col: pa.Array) -> pa.Array:
    import zstandard
    plain = zstandard.ZstdDecompressor().decompress
    return pa.array([plain(t.as_buffer()) for t in col], pa.large_binary())


def _buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of packed texts."""
    return text_buffer(_unpack(col).cast(pa.large_string()))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _triggers(src: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b, key, n): the triggers of every text with their number of phrases."""
    out = T.StructType.fromDDL("a long, b long, key long, n long")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                own = offsets[lo: hi + 1]
                text, _, _, key, _ = phrases(*units(data[own[0]: own[-1]], own - own[0], scheme), scheme)
                both = np.stack([text.astype(np.int64), _signed(key)])
                uniq, n = np.unique(both, axis=1, return_counts=True) if len(text) else (both, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a[lo + uniq[0]]), pa.array(b[lo + uniq[0]]),
                                                  pa.array(uniq[1]), pa.array(n, pa.int64())], names=out.fieldNames())

    return src.select("a", "b", "text").mapInArrow(run, out)


def _parsed(src: DataFrame, keys: DataFrame, scheme: Scheme, finish: Callable, result: T.StructType) -> DataFrame:
    """Every row with its result if no trigger of it repeats, else with its
    packed text and its phrases of repeated triggers."""
    packed = add_columns(src, "z binary", lambda col: [_pack(col)], keep=["doc_id", "a", "b"])
    joined = packed.join(keys, ["a", "b"], "left").select("doc_id", "a", "b", "z", "keys")
    extra = T.StructType.fromDDL("key array<long>, content array<long>, first array<int>, n array<int>")
    out = T.StructType(joined.schema.fields[:4] + extra.fields + result.fields)

    def run(batches):
        for batch in batches:
            data, offsets = _buffer(batch.column(3))
            open_ = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            found = [[] for _ in range(4)]
            sizes = np.zeros(batch.num_rows, np.int64)
            results = []
            for lo, hi in slices(offsets):
                own = offsets[lo: hi + 1]
                raw = data[own[0]: own[-1]]
                h, counts = units(raw, own - own[0], scheme)
                text, first, n, key, content = phrases(h, counts, scheme)
                keep = np.zeros(len(text), bool)
                edge = np.searchsorted(text, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    if open_[lo + i]:
                        mine = slice(edge[i], edge[i + 1])
                        keep[mine] = np.isin(_signed(key[mine]), batch.column(4)[lo + i].values.to_numpy())
                        results.append(None)
                    else:
                        results.append(finish(raw[own[i] - own[0]: own[i + 1] - own[0]], np.zeros(0, np.int64)))
                sizes[lo:hi] = np.bincount(text[keep], minlength=hi - lo)
                for store, x in zip(found, (_signed(key), _signed(content), first, n)):
                    store.append(x[keep])
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
            cols = [batch.column(0), batch.column(1), batch.column(2),
                    pa.array([z if o else None for z, o in zip(batch.column(3).to_pylist(), open_)], pa.binary())]
            cols += [_lists(x, sizes, k) for x, k in zip(flat, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols + _columns(results, result), names=out.fieldNames())

    return joined.mapInArrow(run, out)


def _columns(results: list, result: T.StructType) -> list[pa.Array]:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return [pa.array([None if r is None else r[i] for r in results], kinds[f.dataType.simpleString()])
            for i, f in enumerate(result.fields)]


def _spelled(texts: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows (key, content, c, n, body) of the wanted dictionary phrases with
    their own text."""
    out = T.StructType.fromDDL("key long, content long, c long, n int, body binary")
    joined = texts.join(wanted, ["a", "b"]).select("z", "wanted")

    def run(batches):
        for batch in batches:
            data, offsets = _buffer(batch.column(0))
            for i, asked in enumerate(batch.column(1).to_pylist()):
                raw = data[offsets[i]: offsets[i + 1]].tobytes()
                parts = raw.split() if scheme.words else None

                def body(start: int, n: int) -> bytes:
                    stop = start + n + scheme.size - 1
                    return raw[start:stop] if parts is None else b" ".join(parts[start:stop])

                rows = [(w["key"], w["content"], w["c"], w["n"], body(w["first"], w["n"])) for w in asked]
                kinds = (pa.int64(),) * 3 + (pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                                 names=out.fieldNames())

    return joined.mapInArrow(run, out)


def _counted(texts: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """As ``_ordered``, window by window, of the phrases of hot triggers: the
    hashes of their windows are counted without their text."""
    out = T.StructType.fromDDL("key long, content long, c long, off int, same long")
    joined = texts.join(wanted, ["a", "b"]).select("z", "wanted")

    def run(batches):
        for batch in batches:
            data, offsets = _buffer(batch.column(0))
            for i, asked in enumerate(batch.column(1).to_pylist()):
                raw = data[offsets[i]: offsets[i + 1]]
                h, _ = units(raw, np.array([0, len(raw)], np.int64), scheme)
                asked.sort(key=lambda w: w["first"])
                while asked:
                    lo = asked[0]["first"]
                    some = [w for w in asked if w["first"] < lo + PIECE]
                    asked = asked[len(some):]
                    n = np.array([w["n"] for w in some], np.int64)
                    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    first, *own = (np.repeat(np.array([w[k] for w in some], np.int64), n) for k in ("first", "key", "content", "c"))
                    every = _signed(Rolling(h[lo: some[-1]["first"] + some[-1]["n"] + scheme.size - 1]).all(scheme.size))
                    cols = [pa.array(x) for x in own] + [pa.array(off, pa.int32()), pa.array(every[first + off - lo])]
                    yield pa.RecordBatch.from_arrays(cols, names=out.fieldNames())

    windows = stage(joined.mapInArrow(run, out), "windows")
    again = windows.groupBy("key", "same").agg(F.sum("c").alias("n")).where("n > 1").select("key", "same") \
        .withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return windows.where("c = 1").withColumn("deal", F.pmod(F.xxhash64("content", "off"), F.lit(DEALS)).cast("int")) \
        .join(again, ["key", "same", "deal"]).select("key", "content", "off", F.lit(1).alias("n"), F.unhex(F.lit("80")).alias("marks"))


def _window_hashes(bodies: pa.Array, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all windows of the bodies, windows per body)."""
    h, counts = units(*text_buffer(bodies.cast(pa.large_binary()).view(pa.large_string())), scheme)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    hashes = Rolling(h).all(scheme.size)
    return hashes[left[: len(hashes)] >= scheme.size], counts - scheme.size + 1


def _ordered(spelled: DataFrame, scheme: Scheme, locate: Callable | None) -> DataFrame:
    """(key, content, off, n, marks) of phrases that occur once: which of their
    windows also occur in another phrase (bits, most significant first).
    ``locate`` (bodies, flags of their windows) may find the occurrences anew."""
    out = T.StructType.fromDDL("key long, content long, off int, n int, marks binary")
    parts = int(spelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spelled.repartition(parts, "key").sortWithinPartitions("key")

    def verdicts(t: pa.Table) -> pa.RecordBatch:
        bodies = t["body"].combine_chunks()
        hashes, n = _window_hashes(bodies, scheme)
        at = np.cumsum(n) - n
        which = np.repeat(np.arange(len(n)), n)
        hashes = mix(hashes + t["key"].to_numpy().view(np.uint64)[which] * _BYTES[3])
        _, group = np.unique(hashes, return_inverse=True)
        once = t["c"].to_numpy() == 1
        many = np.bincount(group, weights=t["c"].to_numpy()[which])[group] >= 2
        some = np.flatnonzero(once & (np.bincount(which, weights=many, minlength=len(n)) > 0))
        flags = [many[at[i]: at[i] + n[i]] for i in some.tolist()]
        if locate is not None:
            flags = locate([bodies[i].as_py() for i in some.tolist()], flags)
        t = t.select(["key", "content", "n"]).take(pa.array(some))
        t = t.add_column(2, "off", pa.array(np.zeros(len(some), np.int32)))
        marks = pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.columns] + [marks], names=out.fieldNames())

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < GATHER:
                continue
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            cut = int(np.flatnonzero(key == key[-1])[0])      # the last trigger may go on
            if cut:
                yield verdicts(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            size = t.num_rows - cut
        if size:
            yield verdicts(pa.Table.from_batches(held))

    return rows.mapInArrow(run, out)


def _finished(texts: DataFrame, marks: DataFrame, scheme: Scheme, finish: Callable, result: T.StructType) -> DataFrame:
    """doc_id and result of the texts with repeated triggers."""
    joined = texts.join(marks, ["a", "b"], "left").select("doc_id", "z", "marks")
    out = T.StructType([T.StructField("doc_id", T.LongType())] + result.fields)

    def run(batches):
        for batch in batches:
            data, offsets = _buffer(batch.column(1))
            results = []
            for i, marked in enumerate(batch.column(2).to_pylist()):
                starts = [np.zeros(0, np.int64)]
                for m in marked or []:
                    if m["marks"] is None:
                        starts.append(np.arange(m["first"], m["first"] + m["n"]))
                    else:
                        bits = np.unpackbits(np.frombuffer(m["marks"], np.uint8))[: m["k"]]
                        starts.append(m["first"] + m["off"] + np.flatnonzero(bits))
                results.append(finish(data[offsets[i]: offsets[i + 1]], np.concatenate(starts)))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + _columns(results, result), names=out.fieldNames())

    return joined.mapInArrow(run, out)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n units a window of ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, scheme: Scheme, finish: Callable, schema: str, doc_id: str = "doc_id",
                   text: str = "text", locate: Callable | None = None) -> DataFrame:
    """doc_id and the columns of ``schema`` for every row of ``docs``:
    ``finish`` (the text's bytes, starts of its repeated windows) gives them."""
    spark = docs.sparkSession
    configure(spark)
    result = T.StructType.fromDDL(schema)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                      F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2 ** 63))).alias("a"),
                      F.xxhash64(body).alias("b"), body.alias("text"))
    found = stage(_triggers(src, scheme), "triggers")
    again = found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    keys = found.join(again, "key").groupBy("a", "b").agg(F.collect_set("key").alias("keys"))
    parsed = stage(_parsed(src, keys, scheme, finish, result), "parsed")
    release(found)
    texts = parsed.where("z IS NOT NULL")

    every = texts.select("a", "b", F.explode(F.arrays_zip("key", "content", "first", "n")).alias("p")) \
        .select("a", "b", "p.*")
    entries = stage(every.groupBy("key", "content").agg(F.count("*").alias("c"),
                                                        F.min(F.struct("a", "b", "first", "n")).alias("at")), "entries")
    wide = stage(entries.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "wide")

    def wanted(some: DataFrame) -> DataFrame:
        return entries.join(some, "key").select("at.a", "at.b", F.struct(
            "key", "content", "c", F.col("at.first").alias("first"), F.col("at.n").alias("n")).alias("w")) \
            .groupBy("a", "b").agg(F.collect_list("w").alias("wanted"))

    seen = texts.select("a", "b", "z").dropDuplicates(["a", "b"])
    single = _ordered(_spelled(seen, wanted(wide.where(F.col("k") <= HOT)), scheme), scheme, locate)
    hot = wide.where(F.col("k") > HOT)
    if not hot.isEmpty():
        single = single.unionByName(_counted(seen, wanted(hot), scheme))
    whole = entries.where("c > 1").select("key", "content", F.lit(0).alias("off"), F.lit(0).alias("k"),
                                          F.lit(None).cast("binary").alias("marks"))
    verdict = whole.unionByName(single.withColumnRenamed("n", "k"))
    marks = every.distinct().join(verdict, ["key", "content"]).groupBy("a", "b").agg(
        F.collect_list(F.struct("first", "n", "off", "k", "marks")).alias("marks"))
    done = parsed.where("z IS NULL").select("doc_id", *result.fieldNames())
    return done.unionByName(_finished(texts.select("doc_id", "a", "b", "z"), marks, scheme, finish, result))
