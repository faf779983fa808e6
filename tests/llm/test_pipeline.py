"""Registered queries against their SQL, and the pipeline's stages."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline
from pagemill.llm import queries
from pagemill.llm.stored import stored
from pagemill.plans import compare

LAST = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")


def test_every_operator_has_its_query():
    names = set(spark_entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare.difference(queries.QUERIES[name](spark, SF_DIR), compare.connect(SF_DIR), queries.ORACLES[name]) is None


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    long_item = max((r["text"] for r in benchmark), key=len)
    text = docs.filter("length(text) > 2000").orderBy("doc_id").first()["text"]
    rows = [(-10, text, "en", "s", 1), (-9, text + " more", "en", "s", 1), (-8, text[:900] + " " + long_item + " " + text[900:], "en", "s", 1),
            (-7, "12345 67890", "en", "s", 11), (-6, text[::-1] + " password=abcdefgh1234", "en", "s", 1), (-5, None, None, None, None)]
    extra = spark.createDataFrame(rows, docs.schema)
    now = docs.unionByName(extra)
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF_DIR).persist()
        ids[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name != "tokens":
            assert now.columns == docs.columns
        if name == "secret_scan":
            assert "password" not in now.filter("doc_id = -6").first()["text"]
    assert {-7, -5} & ids["language"] == set() and {-10, -9, -8, -6} <= ids["language"]
    assert -10 in ids["near_duplicates"] and -9 not in ids["near_duplicates"]
    assert -8 not in ids["decontamination"] and ids["secret_scan"] == ids["decontamination"] == ids["tokens"]


def through(spark, docs):
    """The documents after each stage, each written and read again as run() does."""
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), "test-stage")
        held[name] = docs
    return held


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    held = through(spark, docs)
    assert all(d.count() == 0 for d in held.values()) and held["tokens"].columns == LAST


def test_a_corpus_without_labels_with_clashing_columns_ties_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = {"score": "s", "margin": "m", "lang_pred": "x", "leak_items": "l", "ids": "i", "n_shingles": "n", "kept": "k", "component_id": "c"}
    plain = docs.filter("doc_id % 4 = 0").withColumns({"lang": F.lit(None).cast("string"), **{c: F.lit(v) for c, v in names.items()}})
    twice = plain.orderBy("doc_id").limit(3)
    odd = spark.createDataFrame([(None, "no id but words enough to be some kind of text", None, None, 1), (-3, "", None, None, 0), (-2, None, None, None, 0)], docs.schema)
    rows = plain.unionByName(twice).unionByName(odd, allowMissingColumns=True)
    held = through(spark, rows)
    # Nothing to learn a language from: whatever has letters stays, with its columns.
    letters = rows.filter(F.col("text").rlike(r"\p{L}"))
    assert held["language"].count() == letters.count() and held["language"].columns == rows.columns
    assert {r[0] for r in held["language"].select("score").distinct().collect()} <= {"s", None}
    for name in ("near_duplicates", "decontamination", "secret_scan"):
        assert held[name].columns == rows.columns
        assert {r["leak_items"] for r in held[name].collect()} <= {"l", None}
    assert held["tokens"].columns == LAST and held["tokens"].count() == held["secret_scan"].count() <= held["near_duplicates"].count()
    # Of exact copies, rows with one id among them, the smallest id stays.
    ids = {r["doc_id"] for r in held["near_duplicates"].select("doc_id").collect()}
    copies = plain.filter("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("first"), F.collect_list("doc_id").alias("all")).filter("size(all) > 1").collect()
    assert all(not (set(r["all"]) - {r["first"]}) & ids for r in copies)


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns == LAST
