"""Operator 1: language identification by compression.

Every learned language has a zstandard raw-content dictionary made of
training text. A text is cut into blocks of ``BLOCK`` bytes (short blocks
draw on the dictionary rather than on their own past); the language whose
dictionary gives the fewest compressed bytes over all blocks wins. What is
compressed are all words of the text in their order, lower-cased and
stripped of digits and punctuation; no block knows the others. Ties go to
the language with more training documents, then to the smaller name.
The margin is the share of bytes saved against the runner-up; ``accepted``
is false where it is below ``margin`` (a narrow decision) and for ``und``.

``fit`` reads labelled rows only. Per language its sample is the text with
the smallest hash in each of ``SAMPLE_BUCKETS`` hash buckets, cut to
``SAMPLE_CHARS`` characters: a bound of SAMPLE_BUCKETS * SAMPLE_CHARS
characters per language whatever the corpus size; lines that several
sampled texts share (licences, menus) say nothing about a language and are
left out of the dictionaries. Rows with a null label
or a text without letters are not learned from. Null texts and texts
without a letter are predicted ``und`` with score 0. With nothing learned
every text is ``und``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import add_columns

BLOCK = 4096
LEVEL = 5
WORD = re.compile(r"[^\W\d_]+")
SAMPLE_BUCKETS = 48
SAMPLE_CHARS = 2000
MAX_LANGUAGES = 500
NATS_PER_BYTE = 0.35     # how fast the score grows with saved bytes


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[int, bytes]]:
    """language -> (number of training rows, dictionary)."""
    src = train.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")) \
        .where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    hashed = src.withColumn("h", F.xxhash64("t")).withColumn("b", F.pmod("h", F.lit(SAMPLE_BUCKETS)))
    best = hashed.groupBy("l", "b").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    counts = {r.l: r.n for r in best.groupBy("l").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    picked = hashed.join(F.broadcast(best.drop("n")), ["l", "b", "h"]) \
        .groupBy("l", "b").agg(F.min(F.substring("t", 1, SAMPLE_CHARS)).alias("t"))
    sample = [(r.l, r.t.split("\n")) for r in sorted(picked.collect(), key=lambda r: (r.l, r.b))]
    uses = Counter(line for _, lines in sample for line in set(lines))
    parts: dict[str, list[str]] = {}
    for k, lines in sample:
        parts.setdefault(k, []).extend(x for x in lines if uses[x] == 1)
    return {k: (counts[k], " ".join(WORD.findall(" ".join(v).lower())).encode()) for k, v in parts.items()}


class Model:
    """Compressors of one learned model, best-known languages first."""

    def __init__(self, learned: dict[str, tuple[int, bytes]]):
        import zstandard as z
        self.names = sorted(learned, key=lambda k: (-learned[k][0], k))
        self.compress = []
        for k in self.names:
            d = z.ZstdCompressionDict(learned[k][1], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[i: i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)."""
        if not text or not self.names or not any(c.isalpha() for c in text):
            return "und", 0.0, 0.0
        size = self.sizes(" ".join(WORD.findall(text.lower())).encode())
        best = min(range(len(size)), key=size.__getitem__)
        score = 1.0 / sum(math.exp(-NATS_PER_BYTE * (s - size[best])) for s in size)
        rest = min((s for i, s in enumerate(size) if i != best), default=None)
        return self.names[best], score, 1.0 if rest is None else (rest - size[best]) / rest


_MODELS: dict[str, Model] = {}   # of one Python worker


def classify(docs: DataFrame, learned: dict[str, tuple[int, bytes]], text: str = "text",
             keep: list[str] | None = None, margin: float = 0.01) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    key = uuid.uuid4().hex

    def fn(col):
        model = _MODELS.get(key)
        if model is None:
            _MODELS.clear()
            model = _MODELS[key] = Model(shared.value)
        got = [model.predict(t) for t in col.to_pylist()]
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                pa.array([g[2] for g in got], pa.float64()),
                pa.array([g[0] != "und" and g[2] >= margin for g in got], pa.bool_())]

    return add_columns(docs, "lang_pred string, score double, margin double, accepted boolean", fn, text, keep)
