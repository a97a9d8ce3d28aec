"""Operator 6: toxicity by weak supervision.

Voters are words and word prefixes (``stem*``) that occur more often in
toxic than in clean training texts (the lexicon), and fixed patterns of
shouting and masked words. Each voter fires or abstains. A generative
model fitted by expectation maximisation gives every voter its firing rates
on toxic and clean texts (its accuracy) and the correlations of voters
within a class; voters that fire together share their weight. A linear
classifier over all vocabulary tokens is then trained on the posterior
labels, and its scale and offset are set on the training labels.

``fit`` learns from a bounded sample of labelled rows: at most ``SAMPLE``
toxic and as many clean ones, those with the smallest hash of their id,
weighted back to the true shares. Null labels are skipped, an id labelled
twice is toxic if any label is. Null and empty texts have no tokens and
score the offset. Without both classes every score is the share of toxic
labels (0 without labels).
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure
from .base import add_columns, stage

SAMPLE = 5000          # labelled rows of each class that are learned from
VOCABULARY = 4096      # tokens the linear classifier knows
VOTERS = 256           # of these, the most telling ones vote
MIN_ROWS = 3           # sampled rows a token must occur in
TELLING = 15.0         # G statistic of a token that counts (thousands are looked at)
RATIO = 4.0            # a voter's rate on toxic texts against that on clean ones
STEMS = (4, 5, 6)      # lengths of prefixes

WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "!shouting": re.compile(r"[A-Z]{4,}(?:\W+[A-Z]{4,}){2}"),
    "!masked": re.compile(r"[A-Za-z][*@#$%]{2,}[A-Za-z]?"),
    "!marks": re.compile(r"[!?]{3,}"),
}


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words, their stems, and the patterns that match."""
    if not text:
        return set()
    found = set(WORD.findall(text.lower()))
    out = set(found)
    for n in STEMS:
        out.update([w[:n] + "*" for w in found if len(w) > n])
    out.update(name for name, rx in PATTERNS.items() if rx.search(text))
    return out


class Model(NamedTuple):
    weights: dict[str, float]
    offset: float
    voters: dict[str, tuple[float, float]]     # firing rates on (toxic, clean) texts


def _sample(labels: DataFrame, doc_id: str, label: str) -> tuple[DataFrame, dict[int, float]]:
    """Sampled (id, y) and the weight of a row of each class."""
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()) \
        .groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect() if r.y in (0, 1)}
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for y in (1, 0)]
    return picked[0].unionByName(picked[1]), {y: n / min(n, SAMPLE) for y, n in total.items()}


def _gain(p: np.ndarray, n: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """G statistic of each token, signed by the class it speaks for."""
    q = n - p
    cells = [(p, n * pos / (pos + neg)), (q, n * neg / (pos + neg)),
             (pos - p, (pos + neg - n) * pos / (pos + neg)), (neg - q, (pos + neg - n) * neg / (pos + neg))]
    g = sum(np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / np.maximum(e, 1e-12)), 0.0) for a, e in cells)
    return np.where(p / pos >= q / neg, g, -g)


def label_model(votes: np.ndarray, start: np.ndarray, weight: np.ndarray, rounds: int = 30):
    """(posterior of toxic per row, rates on toxic, rates on clean, correlation).

    Expectation maximisation of a two-class model of firing voters; a voter's
    log-likelihood counts by the inverse of its correlated company."""
    post = np.clip(start, 0.02, 0.98)
    corr = np.eye(votes.shape[1])
    for _ in range(rounds):
        w1, w0 = post * weight, (1 - post) * weight
        r1 = (votes.T @ w1 + 0.1) / (w1.sum() + 1.0)
        r0 = (votes.T @ w0 + 0.01) / (w0.sum() + 1.0)
        centred = votes - post[:, None] * r1 - (1 - post)[:, None] * r0
        cov = (centred * weight[:, None]).T @ centred / weight.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / sd[:, None] / sd[None, :]
        share = 1.0 / np.maximum((corr ** 2).sum(1), 1.0)
        prior = np.log(w1.sum() + 1) - np.log(w0.sum() + 1)
        z = prior + votes @ (share * (np.log(r1) - np.log(r0))) + (1 - votes) @ (share * (np.log1p(-r1) - np.log1p(-r0)))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return post, r1, r0, corr


def _linear(rows: np.ndarray, cols: np.ndarray, size: int, y: np.ndarray, weight: np.ndarray, steps: int = 300):
    """Logistic regression with ridge penalty on sparse 0/1 features (Adam)."""
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, weights=w[cols], minlength=len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(cols, weights=err[rows], minlength=size) + 3e-4 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _scale(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic a * z + b on the labels (Newton steps, a >= 0)."""
    a, b = 1.0, 0.0
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        e, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        ha, hb, hab = (h * z * z).sum() + 1e-3, h.sum() + 1e-6, (h * z).sum()
        det = ha * hb - hab * hab
        ga, gb = (e * z).sum() + 1e-3 * (a - 1), e.sum()
        a, b = max(0.05, a - 0.5 * (hb * ga - hab * gb) / det), b - 0.5 * (ha * gb - hab * ga) / det
    return a, b


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the rows of ``labels`` alone; restrict these beforehand."""
    configure(docs.sparkSession)
    picked, weights = _sample(labels, doc_id, label)
    if len(weights) < 2:
        only = float(max(weights, default=0))
        return Model({}, 30.0 if only else -30.0, {})
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    labelled = src.join(F.broadcast(picked), "id").dropDuplicates(["id"])      # at most 2 * SAMPLE ids
    rows = stage(add_columns(labelled, "t array<string>", lambda col: [
        pa.array([sorted(tokens(x)) for x in col.to_pylist()], pa.list_(pa.string()))], keep=["id", "y"]), "labelled")
    each = rows.select("id", "y", F.explode("t").alias("t"))
    count = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = float(count.get(1, 0)), float(count.get(0, 0))
    if not pos or not neg:
        return Model({}, 30.0 if pos else -30.0, {})
    stats = each.groupBy("t").agg(F.sum("y").alias("p"), F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS)
    lift = F.abs(F.col("p") / pos - (F.col("n") - F.col("p")) / neg) / F.sqrt(F.col("n") + 5.0)
    best = stats.withColumn("lift", lift).orderBy(F.desc("lift"), "t").limit(VOCABULARY).collect()
    vocab = [r.t for r in best]
    gain = _gain(np.array([r.p for r in best], float), np.array([r.n for r in best], float), pos, neg)
    index = docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(vocab)], "t string, i int")
    got = rows.select("id", "y").join(
        each.join(F.broadcast(index), "t").groupBy("id").agg(F.collect_list("i").alias("at")), "id", "left").collect()
    y = np.array([r.y for r in got], float)
    weight = np.where(y == 1, weights[1], weights[0])
    at = [np.asarray(r["at"] or [], np.int64) for r in got]
    line = np.repeat(np.arange(len(got)), [len(a) for a in at])
    cols = np.concatenate(at) if at else np.zeros(0, np.int64)

    p, n = np.array([r.p for r in best], float), np.array([r.n for r in best], float)
    ratio = (p + 0.5) / (pos + 1) / ((n - p + 0.5) / (neg + 1))
    chosen = np.argsort(-gain, kind="stable")[:VOTERS]
    chosen = chosen[(gain[chosen] > TELLING) & (ratio[chosen] > RATIO)]
    place = np.full(len(vocab), -1)
    place[chosen] = np.arange(len(chosen))
    votes = np.zeros((len(got), len(chosen)))
    hit = place[cols] >= 0
    votes[line[hit], place[cols[hit]]] = 1
    if not len(chosen):
        share = float((y * weight).sum() / weight.sum())
        return Model({}, float(np.log(share / (1 - share))), {})
    strength = np.maximum(gain[chosen], 0) / gain[chosen].sum()
    start = np.where((votes * strength).sum(1) > np.median(strength), 0.9, 0.05)
    post, r1, r0, _ = label_model(votes, start, weight)
    told = (np.abs(gain) > TELLING)[cols]
    line, cols = line[told], cols[told]
    w, b = _linear(line, cols, len(vocab), post, weight)
    a, c = _scale(b + np.bincount(line, weights=w[cols], minlength=len(y)), y, weight)
    return Model({t: float(a * x) for t, x in zip(vocab, w) if abs(x) > 1e-6}, float(a * b + c),
                 {vocab[j]: (float(p), float(q)) for j, p, q in zip(chosen, r1, r0)})


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score double`` (0 to 1) and ``predicted int`` (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.offset))

    def fn(col):
        weights, offset = shared.value
        known = weights.keys()
        z = np.array([offset + sum(weights[t] for t in known & tokens(x)) for x in col.to_pylist()], float)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return add_columns(docs, "score double, predicted int", fn, text, keep)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with its columns."""
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{text}`").alias("body"))
    return score(rows, model, "body", keep=["row"]).where("predicted = 0").select("row.*")


def in_training(doc_id: Column) -> Column:
    """crc32 of the id as text is not divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0
