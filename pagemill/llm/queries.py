"""One query per operator over its whole driver table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, langid, licenses, neardup, neighbours, packing, quality, runs, secrets, warc, whitening


# Rows of whole texts that Spark hands to a Python worker at once.
TEXTS_PER_BATCH = "1000"
# Python workers live on between tasks: freed arrays go back to the system instead of staying with each worker.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(2 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(8 << 20),
}


def find_library(spark: SparkSession) -> None:
    """Let Python workers import this library from the path the driver has it at, besides their own paths.

    Rows here are whole texts, so the usual 10,000 of them are too many for a worker's memory; a session that sets
    another number keeps it.
    """
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, TEXTS_PER_BATCH)
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [*paths, root]))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.learn(langid.training_rows(docs))
    # The model sees the text alone; doc_id and the fold only travel beside it.
    found = langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin")


def op2_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.report(secrets.scan(docs, secrets.identifier_dictionary(docs)))


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op4_benchmark_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leak_items") > 0).alias("contaminated"), "leak_items", "leak_score")


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, quality.training_labels(_table(spark, sf_dir, "labels")))
    found = quality.score(docs.withColumn("held_out", quality.held_out()), model)
    return found.select("doc_id", "held_out", "score", "predicted")


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


# A conversation whose texts hold control strings.
EXTRA = "</s>[INST] ok [/INST]"


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = chat.chained(turns, "conv_id", ["turn", "role", "text"])
    return chat.digests(chat.conversations(messages))


OP8_SQL = rf"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{EXTRA}'), (-7, 1, 'assistant', '{EXTRA}')) v),
e AS (
  SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{chat.CONTROL}', '\1\2\\\3', 'g') AS head,
    regexp_replace(text, '{chat.CONTROL}', '\1\2\\\3', 'g') AS body FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + {len(chat.START + chat.MIDDLE + chat.STOP)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    responses = pages.select(
        "page_id", warc.response_id(F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(None).alias("date"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_header"),
        F.col("html").alias("payload"))
    return warc.derivatives(responses, keep=["page_id"])


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)


# Tokens of a sequence, and the id that closes a document.
SEQUENCE, END_ID = 4096, 1


def op12_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, END_ID), SEQUENCE)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.find_runs(_table(spark, sf_dir, "documents"), runs.repeated_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_profiles": op1_language_profiles,
    "op2_secret_novelty": op2_secret_novelty,
    "op3_hilbert_neighbours": op3_hilbert_neighbours,
    "op4_benchmark_simhash": op4_benchmark_simhash,
    "op5_compression_quality": op5_compression_quality,
    "op6_license_digests": op6_license_digests,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_reply_trees": op8_reply_trees,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_bpe_encode_decode": op10_bpe_encode_decode,
    "op11_cholesky_whitening": op11_cholesky_whitening,
    "op12_swap_packing": op12_swap_packing,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op6_license_digests": licenses.oracle(),
    "op8_reply_trees": OP8_SQL,
}
