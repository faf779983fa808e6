"""Secret scans against plain matching, and the compression of candidates."""

import hashlib
import random
import re
import string

import pytest

from pagemill.llm import secrets

DOCS = "doc_id long, text string, secret_spans string"
KEY = "AKIA" + "IOSFODNN7EXAMPLE"
TEXTS = [
    "password=hunter2hunter2", "password=short", 'API_KEY" : "abcdefgh12"', "Token  =  'abc.def-ghi_jkl'", "apikey:12345678", "secret\t= 12345678",
    "secret: \"token\" : abcdefghij", "token=token=abcdefghij", KEY, "AKIA123", "xx" + KEY + KEY, "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "G",
    "é" * 5 + " passwd = " + "deadbeef" * 5, "paſſword=abcdefghij", "toKen=abcdefghij", "", None, "plain prose without anything",
    "bearer Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg and prose", "the key lies there", "the token thestonanherewhtionblering lies here",
]


def plain_base(text):
    text = text or ""
    found = []
    pattern = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for m in re.finditer(pattern + "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def test_base_spans_equal_plain_matching(spark):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None), (None, KEY, None)]
    got = secrets.report(secrets.scan(spark.createDataFrame(rows, DOCS), b"")).collect()
    want = []
    for d, t, _ in rows:
        base = plain_base(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        want.append((repr(d), *(sum(x[3] == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((repr(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == sorted(want)


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_spans_are_in_order_and_novel_ones_only_add(text):
    base, novel = secrets.base_spans(text), secrets.novel_spans(text, b"")
    assert base == sorted(base, key=lambda s: (s[0], secrets.KINDS.index(s[2])))
    for a, b, _ in novel:
        assert b - a >= 16 and re.fullmatch("[A-Za-z0-9+/_=-]+", text[a:b])


def test_known_identifiers_are_not_novel():
    secret, name = "q8Zt3LmX9vRb2KdW7yHs", "session_token_cache_v2_entry"
    around = "the token is kept as "
    assert secrets.marginal_bytes(secret, around, b"") >= len(secret)
    assert secrets.marginal_bytes(name, around, b"") > 8 >= secrets.marginal_bytes(name, around, b"session_token_cache_v2_entry handler")
    text = f"token in {name}: {name}; token {secret}"
    assert [text[a:b] for a, b, _ in secrets.novel_spans(text, name.encode())] == [secret]


def test_whole_private_keys_and_bearer_tokens():
    rng = random.Random(3)
    def run(n):
        return "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))

    body = "\n".join([run(64), run(64), run(64), run(7) + "="])
    for name in ("RSA PRIVATE KEY", "PRIVATE KEY"):
        text = f"before\n-----BEGIN {name}-----\n{body}\n-----END {name}-----\nafter"
        assert [text[a:b] for a, b, _ in secrets.novel_spans(text, b"")] == [body]
        text = f"before\n-----BEGIN {name}-----\n{body}\n"
        assert [text[a:b] for a, b, _ in secrets.novel_spans(text, b"")] == [body]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    for text in (f"Authorization: Bearer {jwt}", f"{jwt} is the bearer token", "the token that is " + "quite " * 30 + jwt, f"our api key {jwt}."):
        assert [text[a:b] for a, b, _ in secrets.novel_spans(text, b"")] == [jwt]


def test_identifier_dictionary_counts_all_rows(spark):
    rows = [(1, "the token is alpha beta", None), (2, "secret alpha", None), (3, "no word here gamma", None), (4, None, None), (5, "token " + KEY, None)]
    words = secrets.identifier_dictionary(spark.createDataFrame(rows * 3, DOCS)).decode().split()
    assert words[-1] in ("token", "alpha") and "gamma" not in words and not any(c.isdigit() for w in words for c in w)


def test_redaction_covers_every_span_and_nothing_else(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in secrets.redacted_documents(docs).collect()}
    for i, t in enumerate(TEXTS):
        if not plain_base(t) and not secrets.novel_spans(t or "", b""):
            assert got[i]["text"] == t and got[i]["n_chars"] == i
        else:
            assert secrets.MASK in got[i]["text"] and not plain_base(got[i]["text"]) and got[i]["n_chars"] == len(got[i]["text"])
    assert secrets.masked("abcdefgh", [(1, 3), (2, 5), (6, 7)]) == f"a{secrets.MASK}f{secrets.MASK}h"


def test_long_text_and_empty_table(spark):
    text = "prose " * 100_000 + "password=abcdefgh1" + " prose" * 100_000
    assert secrets.base_spans(text) == [(600_000, 600_018, "assign")]
    empty = spark.createDataFrame([], DOCS)
    assert secrets.report(secrets.scan(empty, secrets.identifier_dictionary(empty))).collect() == []
