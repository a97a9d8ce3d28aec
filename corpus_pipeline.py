"""The corpus pipeline: five stages over the documents, each calling one
operator of ``webloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next one's input. All but the last return
the columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, decontaminate, neardup, secrets, toxicity
from webloom.llm.base import documents, stage
from webloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = documents(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.in_training(F.col("doc_id"))))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5-word shingles, 0.8)."""
    return neardup.deduplicated(docs, shingle=5, similarity=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    masked = secrets.redact(secrets.scan(docs))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    out = bpe.round_trip(docs, tokenizer_path(), ids=True)
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.withColumn("round_trip", F.col("decoded_sha256") == text) \
        .select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is
    written to the shared folder and read back."""
    docs = documents(spark, sf_dir)
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier and the MinHash stage cannot be written as SQL.
ORACLE_SQL = None
