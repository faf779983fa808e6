"""Encoding and decoding against the tokenizers library."""

import random
from contextlib import redirect_stdout
from io import StringIO

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = "ab'stTE \t\n\x1c\x1f\x85  　é́̈ΣςſKǅ123١！🙂‍ﬁ가ᄀ<>|.,"
    extra = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "We'RE"]
    return ["".join(rng.choice(extra) if rng.random() < 0.08 else rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_text_equal_the_library(spark, library, monkeypatch, prose):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 2000)
    texts = [*random_texts(600), prose(5000), None, "", "   ", "same", "same", "x" * 20000]
    rows = [(i if i % 50 else None, t, "b") for i, t in enumerate(texts)]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, batch string"), PATH).collect()
    want = sorted((repr(d), *expected(library, t)) for d, t, _ in rows)
    assert sorted((repr(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == want


def test_words_are_parted_at_the_tokenizers_white_space():
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            white = chr(c).isspace() and not 0x1C <= c <= 0x1F
            assert (len(bpe.split_words(f"a{chr(c)}b")) == 2) == white
            assert bpe._NOT_SPACE.findall(f"a{chr(c)}b") == bpe.split_words(f"a{chr(c)}b")


def test_splitting_never_changes_ids(library):
    for text in random_texts(4000, seed=8):
        parts = [i for w in bpe.split_words(bpe.lowered(text)) for i in library.encode(w, add_special_tokens=False).ids]
        assert parts == library.encode(text, add_special_tokens=False).ids


def test_words_of_many_texts_are_numbered_at_once():
    white = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    # Characters that share bytes with white space, and texts that end and begin amid a word, or are empty.
    near = ["\u0084", "\u2007", "\u200b", "\u2030", "\u2060", "\u20df", "\u3001", "\u0380", "\u1681", "\U0002f000", "A\u0301", "Z\u036f", "A\u0370"]
    rng = random.Random(2)
    noise = ["".join(rng.choice([*white, *near, "AbZ@[", "<", "|", "é"]) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    for texts in ([*random_texts(3000, seed=5), *noise, "", "A", "b<", "|c"], ["", ""], []):
        data = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, data)])
        counts, numbers, found = bpe.number_words(np.frombuffer(b"".join(data), np.uint8), at)
        assert counts.tolist() == [len(bpe.split_words(t)) for t in texts]
        words = [w.decode() for w in found.to_pylist()]
        # Next to "<" or "|" of another text, capitals may be kept: they give the same ids.
        assert [words[n].lower() for n in numbers] == [w.lower() for t in texts for w in bpe.split_words(bpe.lowered(t))]
        for text, own in zip(texts, np.split(numbers, np.cumsum(counts)[:-1]) if texts else [], strict=True):
            kept = "<|" in text or bpe.lowered(text) != text.encode().lower().decode()
            assert not kept or [words[n] for n in own] == bpe.split_words(text)


def test_a_batch_meets_its_ids_alone(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    monkeypatch.setattr(bpe, "LIST_BYTES", 20)
    texts = [*random_texts(80, seed=4), None, "", *["same text."] * 40]
    encoded = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), PATH)
    with redirect_stdout(StringIO()) as plan:
        encoded.explain()
    # No Arrow batch of many batches' numbers, no lists of ids on the heap, and numbers that stay where they are.
    assert "FlatMapCoGroupsInArrow" in plan.getvalue() and "collect_list" not in plan.getvalue()
    assert plan.getvalue().count("Exchange hashpartitioning(batch") == 1
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in encoded.collect()) == [(i, *expected(library, t)) for i, t in enumerate(texts)]


def test_signs_behind_a_word_are_encoded_alone(library):
    rng = random.Random(12)
    letters = "abzé́ΣǅßªʰK١¼Ⅷ가ﬁ'’<>|=~^`\u0338"
    for _ in range(6000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) + "".join(rng.choice(bpe._SIGNS + "a'") for _ in range(rng.randint(0, 4)))
        whole = library.encode(word, add_special_tokens=False).ids
        assert [i for p in bpe.parted(word) for i in library.encode(p, add_special_tokens=False).ids] == whole, word


def test_join_decodes_any_ids(spark, library):
    rows = [(1, [320, 49407, 518]), (2, []), (3, [0, 0, 99999999, 49406]), (4, None)]
    got = {r["k"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "k long, ids array<int>"), bpe.vocabulary(spark, PATH), "k").collect()}
    assert got == {k: library.decode([i for i in ids or [] if i < 49408], skip_special_tokens=False) for k, ids in rows}


def test_text_ids_and_empty_table(spark, library):
    got = bpe.encode_decode(spark.createDataFrame([("a", "The end.")], "doc_id string, text string"), PATH).collect()
    assert [(r["doc_id"], r["ids"]) for r in got] == [("a", expected(library, "The end.")[0])]
    assert bpe.digests(bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH)).collect() == []
