"""Tokens against the library, packings against their rules, the lower bound and the best possible on small cases."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import bpe, packing, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 64


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected_pieces(library, doc_id, text, capacity):
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
    return [(doc_id, i, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes()))
            for i, at in enumerate(range(0, len(ids), capacity))]


def check_places(rows, capacity):
    """Every sequence is filled gapless from 0 and holds no more than it can."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity or len(places) == 1
    return len(sequences)


def fewest(lengths, capacity):
    """The least number of bins, by trying every place."""
    best = len(lengths)

    def put(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= rest[0] and rooms[k] not in rooms[:k]:
                put(rest[1:], [*rooms[:k], rooms[k] - rest[0], *rooms[k + 1 :]])
        put(rest[1:], [*rooms, capacity - rest[0]])

    put(sorted(lengths, reverse=True), [])
    return best


def test_small_cases_come_near_the_best():
    rng, ours, best = random.Random(6), 0, 0
    for _ in range(150):
        lengths = [rng.randint(2, 15) for _ in range(rng.randint(1, 13))]
        number, offset = packing.pack_lengths(np.array(lengths), 20)
        fills = np.bincount(number, weights=lengths)
        assert fills.max() <= 20 and (fills > 0).all()
        ours, best = ours + len(fills), best + fewest(lengths, 20)
    assert best <= ours <= 1.01 * best


def test_exchanges_raise_squared_fill_and_empty_bins():
    rng = np.random.default_rng(1)
    saved = 0
    for low, high in ((20, 60), (30, 41), (10, 50), (34, 34), (5, 80)):
        lengths = rng.integers(low, high + 1, 400)
        first = packing.best_fit(lengths, 100)
        last = packing.local_search([list(b) for b in first], 100)
        assert sorted(x for b in last for x in b) == sorted(lengths.tolist())
        assert max(map(sum, last)) <= 100
        assert sum(sum(b) ** 2 for b in last) >= sum(sum(b) ** 2 for b in first)
        saved += len(first) - len(last)
    assert saved > 3


@pytest.mark.parametrize(("bins", "after"), [
    ([[60, 30], [50, 45], [5, 10]], 2),  # moves alone
    ([[50, 41], [50, 40], [10, 9]], 2),  # a move of 10 and of 9
    ([[70, 20], [75, 5, 5], [25]], 2),  # one for two: 25 for 20, or into room after 5 and 5
    ([[50, 40, 5], [60, 35], [10]], 2),  # 10 for 5, and 5 into room
    ([[90], [60, 30], [8, 12]], 3),  # the best there is
])
def test_single_exchanges(bins, after):
    assert len(packing.local_search([list(b) for b in bins], 100)) == after


def test_two_for_one_and_one_for_two():
    for bins, want in (([[50, 40, 8], [6, 4]], [[4, 6, 40, 50], [8]]), ([[50, 36, 6, 5], [14]], [[14, 36, 50], [5, 6]])):
        state = packing._Exchange(bins, 100)
        assert state.step(1)
        assert [sorted(b) for b in bins] == want and state.fill == [100, sum(want[1])]


def test_defined_results_in_spark(spark, library, prose, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 2000)
    texts = [None, "", "  ", "same text", "same text", "<|endoftext|> É́ don't", *(prose(n) for n in range(0, 200, 3)), "x" * 5000]
    rows = [(i if i % 8 else None, t, 5, -1) for i, t in enumerate(texts)] + [(3, "same text", 5, -1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, length int").repartition(3)
    packed = packing.pack(packing.token_pieces(docs, PATH, CAPACITY, 1, keep_ids=True), CAPACITY)
    got = packed.collect()
    want = [p for r in rows for p in expected_pieces(library, r[0], r[1], CAPACITY)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    assert check_places(got, CAPACITY) <= 1 + -(-sum(r["length"] for r in got) // CAPACITY)
    held = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert all(held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in got)
    assert sum(map(len, held.values())) == sum(r["length"] for r in got)
    assert packing.pack(packing.token_pieces(docs.limit(0), PATH, CAPACITY, 1), CAPACITY).collect() == []
    named = packing.token_pieces(spark.createDataFrame([("d", "a b")], "doc_id string, text string"), PATH, CAPACITY, 1)
    assert [tuple(r) for r in named.collect()] == expected_pieces(library, "d", "a b", CAPACITY)


def test_many_groups_lose_next_to_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 200)
    rng = random.Random(3)
    rows = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 20), None if i % 900 == 0 else 7, 0 if i % 500 == 0 else 9, 250 if i % 700 == 0 else 11]), "old")
            for i in range(5000)]
    pieces = spark.createDataFrame(rows, "k long, length long, offset string").repartition(5)
    got = packing.pack(pieces, 100).collect()
    assert sorted((r["k"], r["length"]) for r in got if r["length"] is not None) == sorted(r[:2] for r in rows if r[1] is not None)
    assert len(got) == len(rows)
    sized = [r for r in got if r["length"]]
    large = sum(r["length"] > 100 for r in sized)
    assert check_places(sized, 100) <= large + 1 + 1.01 * sum(r["length"] for r in sized if r["length"] <= 100) / 100
    # A third of the rows alike are spread like all others.
    hot = spark.createDataFrame([(1, 40, "x")] * 1000 + [(2, 20, "y")] * 1000, "k long, length long, z string")
    assert check_places(packing.pack(hot, 100).collect(), 100) <= 602


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
def test_query_packs_every_document(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_swap_packing(spark, SF_DIR).collect()
    want = [p for r in docs for p in expected_pieces(library, r["doc_id"], r["text"], 4096)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert check_places(got, 4096) == -(-sum(r["length"] for r in got) // 4096)
