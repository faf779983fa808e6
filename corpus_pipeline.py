"""Documents to tokens in five stages, each written as Parquet and read again as the next one's documents.

Defined results: null texts, empty ones and those without letters go in the first stage; a corpus without a single label
keeps all others there, as there is no language to learn.  Of equal texts the row with the smallest doc_id stays, of equal
rows one; rows that share a doc_id but not a text all stay if any does, and rows without doc_id stay.  An empty
table stays empty through all stages.  Extra columns come along to the last stage but one, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, decontaminate, langid, neardup, secrets
from pagemill.llm.queries import find_library
from pagemill.llm.stored import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the corpus; texts that are in none go."""
    find_library(spark)
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: five words, similarity 0.8."""
    find_library(spark)
    return neardup.keep_one(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    find_library(spark)
    # The operator's own columns replace the caller's of these names, which are kept apart meanwhile.
    own = {c: f"_own_{c}" for c in docs.columns if c in ("leak_items", "leak_score")}
    clean = decontaminate.clean_documents(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumnsRenamed({v: k for k, v in own.items()})


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    find_library(spark)
    return secrets.redacted_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of ids and decoded text of every document."""
    find_library(spark)
    encoded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(encoded, keep_ids=True)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("tokens", tokens),
]
# Profiles, signatures, compression and merges are nothing SQL can express; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; the result of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
