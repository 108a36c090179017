"""From documents to token identifiers: filter, deduplicate, redact, mix, encode.

``STAGES`` are applied in order; each gets what the one before it kept, written as Parquet
and read again, so that a stage that fails costs no earlier one. All but the last return the
columns of ``documents``. Rows without an id pass the deduplication; null texts pass every
stage and are encoded as empty ones; a stage without rows returns none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, labelled, minhash, mixing, pii, quality
from kinfold.llm._shared import settle, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject (operator 4).

    It learns from labels outside the held-out fold, with texts of the whole corpus.
    """
    teaches = labelled.fold(F.col("doc_id"), 5) != 0
    machine = quality.learn(labelled.teaching(docs, table(spark, sf_dir, "labels"), "quality", teaches, quality.SAMPLE))
    score = "_" + max(docs.columns, key=len)  # no column's name
    return quality.score(docs, machine, out_col=score).filter(F.col(f"`{score}`") >= 0.3).select(*(F.col(f"`{c}`") for c in docs.columns))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates by shingles of five words (operator 10)."""
    return minhash.dedup(docs, width=5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind (operator 2), and their new lengths."""
    cleaned = pii.redact(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 6)."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of each text and the text they decode to (operator 7)."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = bpe.encode_and_decode(docs.select("doc_id", "source", "text"), path)
    return made.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", first_copies),
    ("PII", without_personal_data),
    ("mixing sources", mixed),
    ("BPE encoding and decoding", encoded),
]

#: SQL has no factorisation machine, MinHash or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
