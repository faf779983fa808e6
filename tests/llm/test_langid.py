"""Rank-order profiles against a plain version, and held-out accuracy."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.llm import langid

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")


def plain_grams(text):
    stream = [" "]
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        stream.append(low if c.isalpha() else " ")
    words = "".join([*stream, " "]).split()
    counts = Counter()
    for w in words:
        counts.update(w)
        padded = f" {w} "
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return counts


def packed(gram):
    value = 0
    for c in gram:
        value = (value << 21) | ord(c)
    return value


def plain_rank(counts, n):
    return [g for g, _ in sorted(((packed(g), c) for g, c in counts.items()), key=lambda x: (-x[1], x[0]))[:n]]


TEXTS = ["The cat, the CAT!", "über Straße 12", "a", " ", "", None, "İstanbul'da", "x1y2z", "ǅ ß", "a" * 50, "one\ttwo  three"]


@pytest.mark.parametrize("piece", [3, 7, 1 << 18])
def test_grams_are_counted_over_pieces(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    for text in TEXTS:
        values, counts = langid.counted(text)
        assert dict(zip(values.tolist(), counts.tolist())) == {packed(g): c for g, c in plain_grams(text).items()}


def test_prediction_equals_plain_distances(spark, prose):
    train = [("aa", prose(200)), ("aa", prose(100)), ("bb", " ".join(w[::-1] for w in prose(300).split())), (None, prose(50)), ("cc", None), ("dd", "123")]
    profiles = langid.learn(spark.createDataFrame(train, "lang string, text string"), 50)
    assert sorted(profiles) == ["aa", "bb"]
    for lang in profiles:
        whole = sum((plain_grams(t) for k, t in train if k == lang), Counter())
        assert profiles[lang] == plain_rank(whole, 50)
    rows = [(i, t, "kept") for i, t in enumerate([prose(20), " ".join(w[::-1] for w in prose(30).split()), *TEXTS])]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), profiles, 50).collect()
    for r in got:
        own = plain_rank(plain_grams(r["text"]), 50)
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        away = {lang: sum(abs(p.index(g) - i) if g in p else 50 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert r["lang_pred"] == best and abs(r["score"] - (1 - away[best] / (50 * len(own)))) < 1e-12


def test_nothing_to_learn_from(spark):
    profiles = langid.learn(spark.createDataFrame([], "lang string, text string"))
    got = langid.predict(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), profiles).collect()
    assert profiles == {} and got[0]["lang_pred"] == "und"
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), {"a": [97]}).collect() == []


@needs_tables
def test_held_out_rows_are_told(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = langid.predict(docs.withColumn("held", langid.held_out()), langid.learn(langid.training_rows(docs)))
    n, right = found.filter("held").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n and right / n >= 0.97


@needs_tables
def test_stage_keeps_prose_and_rejects_what_is_no_text(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    junk = spark.createDataFrame([(-1, "12 34 !!", None, "s", 8), (-2, None, "en", "s", 0), (-3, "漢字仮名交文書", "zz", "s", 7)], docs.schema)
    kept = langid.known_language(docs.unionByName(junk.filter("doc_id <> -3")))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert langid.known_language(junk.filter("doc_id = -1")).count() == 0


def test_stage_keeps_a_corpus_without_labels(spark, prose):
    rows = [(i, prose(30), None) for i in range(20)] + [(20, prose(5), None)] * 3 + [(21, None, None), (22, " 12 !", None), (None, "words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.filter("doc_id < 21 OR doc_id IS NULL").collect()))
    assert langid.known_language(docs.limit(0)).collect() == []


def test_columns_of_its_own_names_stay(spark, prose):
    docs = spark.createDataFrame([(i, prose(40), "aa", f"s{i}", i) for i in range(12)] + [(3, prose(40), None, "x", 1)],
                                 "doc_id long, text string, lang string, score string, margin int")
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and kept.count() == 13 and {r["lang"] for r in kept.collect()} == {"aa"}
    assert {r["score"] for r in kept.collect()} == {"x", *(f"s{i}" for i in range(12))}


def test_more_labels_than_profiles(spark, prose, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    rows = [(lang, (prose(20) + " ") * n) for n, lang in enumerate("abcdef", 1)] + [("g", "12")]
    assert sorted(langid.learn(spark.createDataFrame(rows, "lang string, text string"))) == ["d", "e", "f"]
