"""Benchmark passages against brute force over all windows."""

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa

from pagemill.llm import decontaminate, words

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def weighted(a, b, k=5):
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def brute(text, items):
    own = (text or "").lower().split()
    hits = []
    for item, passage in items:
        words_ = (passage or "").lower().split()
        if item is None or not words_:
            continue
        if len(words_) < 5:
            if own == words_:
                hits.append(item)
        elif len(own) >= 5:
            n = min(len(own), len(words_))
            if any(weighted(own[i : i + n], words_) >= 0.8 for i in range(len(own) - n + 1)):
                hits.append(item)
    return sorted(hits)


def cases(prose):
    items = [(i, prose(prose.rng.randint(12, 60))) for i in range(25)]
    items += [(100, items[3][1]), (101, "one two"), (102, ""), (103, None), (None, prose(30)), (104, "la " * 40)]
    rows = []
    for i in range(60):
        parts = [prose(prose.rng.randint(0, 80))]
        passage = prose.rng.choice(items[:25])[1].split()
        for _ in range(i % 4):
            passage[prose.rng.choice([0, 1, 2, -1, -2, prose.rng.randrange(len(passage))])] = "changed"
        parts.insert(i % 2, " ".join(passage).upper() if i % 5 == 0 else " ".join(passage))
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One Two"), (204, "one two three"), (205, "la " * 35), (206, "la " * 300), (207, prose(3)),
             (208, " ".join(items[0][1].split()[:-1])), (None, items[1][1]), (0, rows[0][1])]
    return items, rows


def test_every_window_is_judged(spark, prose):
    items, rows = cases(prose)
    got = decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((repr(r["doc_id"]), r["leak_items"]) for r in got) == sorted((repr(d), brute(t, items)) for d, t in rows)
    assert all((r["leak_score"] >= 0.8) == bool(r["leak_items"]) for r in got)


def test_case_and_normal_form_do_not_matter(spark):
    item = "árvíztűrő tükörfúrógép és große Straße naïve café déjà vu señor über Ärger façade élan crème brûlée"
    docs = [(1, item.upper()), (2, unicodedata.normalize("NFD", item)), (3, unicodedata.normalize("NFD", item.upper())), (4, item.translate({233: "e", 252: "u"}))]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert {r["doc_id"]: r["leak_score"] for r in got if r["leak_items"]} == {1: 1.0, 2: 1.0, 3: 1.0}


def test_slices_give_the_same(spark, prose, monkeypatch):
    items, rows = cases(prose)
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    whole = sorted((repr(r["doc_id"]), r["leak_items"]) for r in decontaminate.find_leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 7)
    assert sorted((repr(r["doc_id"]), r["leak_items"]) for r in decontaminate.find_leaks(docs, bench).collect()) == whole


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(2)
    hashes = [words.mix(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in rng.integers(5, 60, 80)]
    items = decontaminate.Items(list(range(80)), hashes)
    near = items.prints[rng.integers(0, 80, 500)]
    for _ in range(22):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) * (rng.random(500) < 0.8).astype(np.uint64)
    window, item = items.within_radius(near)
    distance = np.bitwise_count(near[:, None] ^ items.prints[None, :])
    assert {*zip(window.tolist(), item.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS)))}


def test_clean_documents_keep_their_columns(spark, prose):
    items = [(1, prose(30))]
    docs = spark.createDataFrame([(1, items[0][1], "x", 1), (2, prose(50), None, 2)], "doc_id long, text string, leak_items string, item_id long")
    clean = decontaminate.clean_documents(docs, spark.createDataFrame(items, ITEMS))
    assert clean.columns == ["doc_id", "text", "item_id"] and [r["doc_id"] for r in clean.collect()] == [2]


def test_empty_tables(spark, prose):
    docs, bench = spark.createDataFrame([(1, prose(40))], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.find_leaks(docs, bench).collect()[0]["leak_items"] == []
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []


def test_long_document(spark, prose):
    items = [(1, prose(40))]
    text = prose(300_000) + " " + items[0][1] + " " + prose(1000)
    got = decontaminate.find_leaks(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert got[0]["leak_items"] == [1] and len(pa.array([text])[0].as_py()) == len(text)


def test_benchmarks_that_differ_at_the_end_only(spark, prose):
    """The index kept by a worker is told by all of the benchmark, not by how it begins."""
    common = [(i, prose(120)) for i in range(100)]
    last = [prose(80), prose(80)]
    docs = spark.createDataFrame([(k, prose(50) + " " + last[k] + " " + prose(50)) for k in range(2)], DOCS).coalesce(1)
    for k in range(2):
        items = spark.createDataFrame([*common, (100, last[k])], ITEMS)
        got = {r["doc_id"]: r["leak_items"] for r in decontaminate.find_leaks(docs, items).collect()}
        assert got == {k: [100], 1 - k: []}


def test_fingerprints_of_windows_far_apart(prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "RUN_WORDS", 90)
    hashes = next(words.word_hashes(pa.array([prose(1000)])))[1]
    for length in (7, 40, 200):
        starts = np.array(sorted({*range(0, 60, 3), 300, 301, 700, 1000 - length}))
        whole = [decontaminate.simhash(hashes[s : s + length], np.array([0]), length)[0] for s in starts]
        assert decontaminate.simhash(hashes, starts, length).tolist() == whole
