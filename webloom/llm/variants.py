"""Operator 11: spelling variants, grouped by asymmetric q-chunks.

Two words are near if one code point inserted, deleted or replaced turns one
into the other. Of a pair, the longer word (of equal ones: the smaller) is
cut into two disjoint chunks; the other one contributes its positional grams.
The edit lies in one chunk, so the other is a gram of the second word, at
its own place or, behind a lost code point, one place further left. Half a
word alone is a weak key: many words share it. So the chunk with the edit is
cut in two again by the same rule, two to four times by the word's length,
and a key joins all chunks that are preserved: what stands before the piece
that may hold the edit, and what stands after it. A word has 4, 8 or 16
chunk keys and as many gram keys per length, whatever the vocabulary; the
words of one key differ in a piece of at most two code points (up to 32
code points; a sixteenth of longer words). Joined pairs are verified by their
edit distance inside the join.

No side of a join is sent whole to the driver: Spark sizes a stored table by
its files, which hold a word once where the join has up to 32 keys of it, and
compressed. The joins are therefore sort-merge joins by hint.

A word's form is its near word with the largest count, if that is
``FORM_RATIO`` times its own or more; roots follow the forms. Counts grow
fivefold along a chain, so five doublings reach the end of any.

Words are runs of letters of the texts; null texts have none, texts of any
length are read whole, repeated rows and ids count each time, a null id
reads as the empty string. Ties between forms go to the smaller word in
code-point order. An empty table has no words. Only the named columns are
read, so further columns do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure
from .base import release, stage

# Fixed values of the grouping.
LETTERS = "a-zÀ-ÿ"      # after lower-casing A-Z
MIN_LENGTH = 6
MIN_COUNT = 5
FORM_RATIO = 5
DROP_EVERY = 199
DOUBLINGS = 5


def drop_letter(doc_id: Column, run: Column) -> Column:
    """``run`` without one code point, for about one in ``DROP_EVERY`` pairs
    of document and run, by the crc32 of both."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROP_EVERY == 0, F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edit=None,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of ``min_length`` code points or more that occur
    ``min_count`` times or more. ``edit(doc_id, run)`` may shorten a run."""
    low = F.translate(F.col(f"`{text}`").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{int(min_length)},}}"), 0)
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(runs).alias("run"))
    word = edit(F.col("doc_id"), F.col("run")) if edit else F.col("run")
    return found.select(word.alias("word")).where(F.length("word") >= min_length) \
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _pieces(length: Column) -> Column:
    """How many pieces a word of that length is cut into by repeated halving."""
    return F.when(length <= 8, 4).when(length <= 16, 8).otherwise(16)


def _keys(word: Column, length: Column, lost: Column) -> Column:
    """One key per piece of a chunk word of ``length``: the chunks before and
    after it. ``word`` is that word (lost = 0) or one without one code point
    of the piece (lost = 1), whose second chunk stands one place further left."""
    k = _pieces(length)

    def key(i: Column) -> Column:
        start, end = F.floor(i * length / k).cast("int"), F.floor((i + 1) * length / k).cast("int")
        return F.xxhash64(length, i, F.substring(word, 1, start), F.substring(word, end + 1 - lost, F.greatest(length, F.lit(1))))

    return F.transform(F.sequence(F.lit(0), k - 1), key)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of near words of (word, n), in both
    directions, once each."""
    size = F.length("word")
    chunks = words.select("word", "n", F.explode(_keys(F.col("word"), size, F.lit(0))).alias("key"))
    shapes = F.explode(F.array(F.struct(F.lit(0).alias("lost")), F.struct(F.lit(1).alias("lost")))).alias("s")
    grams = words.select("word", "n", shapes).select(
        F.col("word").alias("near"), F.col("n").alias("near_n"),
        F.explode(_keys(F.col("word"), size + F.col("s.lost"), F.col("s.lost"))).alias("key"))
    a, b = F.col("word"), F.col("near")
    once = (F.length(a) == F.length(b) + 1) | ((F.length(a) == F.length(b)) & (a < b))
    near = chunks.join(grams.hint("merge"), (chunks["key"] == grams["key"]) & once & (F.levenshtein(a, b, 1) == 1))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"),
                             F.struct(b.alias("word"), F.col("near_n").alias("n"), a.alias("near"), F.col("n").alias("near_n"))))
    return near.select("word", "n", "near", "near_n").select(both.alias("p")).select("p.*").distinct()


def forms(pairs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n_near, form, form_n) of every word with a near one."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    got = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    large = -F.col("best.less") >= ratio * F.col("n")
    return got.select("word", "n_near", F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that the (word, form) links lead to."""
    now = stage(links.select("word", F.col("form").alias("root")), "hops")
    for _ in range(DOUBLINGS):
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        nxt = stage(now.join(far.hint("merge"), "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "hops")
        release(now)
        if nxt.where("moved").isEmpty():
            break
        now = nxt
    return nxt.select("word", "root")


def group(words: DataFrame) -> DataFrame:
    """``words`` (word, n; one row a word) plus form, root, n_near, form_n."""
    configure(words.sparkSession)
    words = stage(words.select("word", "n"), "words")
    got = stage(forms(near_pairs(words)), "forms")
    ends = roots(got.where("form is not null"))
    return words.join(got.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
