"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, secret scan, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of documents.  An empty table gives an
empty result in each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import exact, packing, quality, secrets, similar
from pairloom.session import made, materialise, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive thresholds reject go.

    A null text has no words and goes; repeated rows are judged alike; null
    languages and sources are groups of their own.
    """
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.

    A null text is an empty one; null ids are smallest; of repeated rows one stays.
    """
    return exact.drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the five-word shingles) the document with the smallest doc_id stays.

    Fingerprints link the closest copies, rare shingles the others (similar.py).
    A null text is an empty one; null ids are largest; of repeated rows one stays.
    """
    return similar.drop_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by [kind]; n_chars follows the new text.

    A null text stays null, and its n_chars becomes null; repeated rows all stay.
    """
    return secrets.masked(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 tokens, with its sequence and place there.

    A null or empty text is its end mark alone; repeated rows each get their pieces.
    """
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

# SQL can't express fingerprints, tokens and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is stored and reread, and what its stage needed for it is released.

    An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = made()
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        release(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
