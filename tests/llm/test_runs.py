"""Runs against brute force over all periods, and the defined results."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from pagemill.llm import queries, runs

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def smallest_period(words):
    border, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - border[-1]


def brute_force(words):
    """Every maximal stretch equal to itself ``q`` words on, for all q, whose smallest period is q."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_force(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
            hashlib.sha256(collapsed.encode()).hexdigest())


@pytest.fixture
def random_words():
    rng = random.Random(4)

    def make():
        kinds, words = rng.choice([1, 2, 2, 3, 5, 50]), []
        for _ in range(rng.randint(0, 14)):
            piece = [rng.randrange(kinds) for _ in range(rng.randint(1, 9))]
            words += piece * rng.choice([1, 1, 2, 4, 5, 9])
        return words

    return make


def test_runs_equal_brute_force(random_words):
    for _ in range(1500):
        words = random_words()
        numbers = np.array(words, np.int32)
        want = brute_force(words)
        assert [tuple(r) for r in runs.runs(numbers).tolist()] == want
        if words:
            assert [tuple(r) for r in runs.runs_of_stretch(numbers).tolist()] == sorted(want)


def test_agreement_is_the_common_prefix(random_words):
    for _ in range(100):
        words = [w + 1 for w in random_words()]
        tour, met, suffixes = runs.SuffixTree(words).euler_tour()
        assert suffixes.tolist() == sorted(range(len(words) + 1), key=lambda i: [*words[i:], 0])
        n = len(words)
        a, b = (np.repeat(np.arange(n), n), np.tile(np.arange(n), n))
        got = runs.Agreement(tour, met)(a[a != b], b[a != b])
        for i, j, common in zip(a[a != b].tolist(), b[a != b].tolist(), got.tolist(), strict=True):
            k = 0
            while max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            assert common == k


def test_periods_longer_than_a_block_and_a_long_text(monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 100)
    rng = random.Random(2)
    period = [f"w{rng.randrange(900)}" for _ in range(5000)]
    text = " ".join([*(f"a{i}" for i in range(70)), *period * 4, *period[:123], "end"])
    numbers, known = runs.numbered(text)
    assert b" ".join(known[i] for i in numbers.tolist()).decode() == text
    assert runs.runs(numbers).tolist() == [[70, 20123, 5000]]


def test_defined_results_in_spark(spark, prose):
    texts = [None, "", " \t\r\n\x0b\x0c ", "a", "A a A a A a A a", "ab " * 6, "x y " * 3, "é é é é é é z", "word\x1cword " * 7,
             "a b a b a b a b b b b b b b", prose(300), prose(300), *(prose(rng_n) for rng_n in range(0, 200, 7))]
    rows = [(i if i % 9 else None, t, "en", i, [1]) for i, t in enumerate(texts)] + [(1, "same " * 8, "x", 0, [2])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int, start array<int>").repartition(3)
    found = runs.report(runs.find_runs(docs))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(expected(r[0], r[1], planted=False)) for r in rows)
    planted = runs.report(runs.find_runs(docs, runs.repeated_tail))
    assert sorted(map(repr, map(tuple, planted.collect()))) == sorted(repr(expected(r[0], r[1], r[0] is not None)) for r in rows)
    assert runs.report(runs.find_runs(docs.limit(0))).collect() == []
    named = spark.createDataFrame([("d", "a b " * 5)], "doc_id string, text string")
    assert [(r["doc_id"], r["n_words"], r["runs"][0]["period"], r["collapsed"]) for r in runs.find_runs(named).collect()] == [("d", 10, 2, "a b")]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").filter("length(text) < 9000").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, SF_DIR).collect()}
    assert docs and all(got[r["doc_id"]] == expected(r["doc_id"], r["text"]) for r in docs)
    assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
