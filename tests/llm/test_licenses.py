"""Licence digests."""

from pagemill.llm import licenses

DOCS = "doc_id long, text string, digest string"


def test_whole_texts_and_notices(spark):
    mit = licenses._MIT
    rows = [
        (1, mit, None), (2, "Copyright (c) 2020 Somebody\nCopyright © 2021 Else\n\n" + mit.upper().replace(",", " ;"), None), (3, mit.replace("\n", " "), None),
        (4, mit + " and more", None), (5, "Some prose.\nReleased under the MIT License.\nMore.", None), (6, "RELEASED UNDER THE MIT LICENCE!", None),
        (7, None, None), (8, "", None), (9, "All rights reserved.", None), (10, "a\nLicensed under CC BY-NC 4.0.\nSPDX-License-Identifier: MIT", None),
        (11, "MIT License\n\nCopyright (c) <year> <owner>\n\n" + mit, None), (None, mit, None), (12, licenses._BSD_HEAD + licenses._BSD_TAIL, None),
        (12, licenses._BSD_HEAD + licenses._BSD_TAIL, None), (13, "x " * 300_000, None),
    ]
    got = licenses.scan(spark.createDataFrame(rows, DOCS), licenses.known_licenses(spark)).collect()
    assert len(got) == len(rows)
    named = {r["doc_id"]: (r["license_id"], r["notices"]) for r in got}
    assert [named[i][0] for i in (1, 2, 3, 4, 6, 7, 8, 9, 11, None, 12)] == ["MIT"] * 3 + [None, "MIT", None, None, None, "MIT", "MIT", "BSD-2-Clause"]
    assert named[5] == (None, "MIT") and named[10] == (None, "CC-BY-NC-4.0,MIT") and named[13] == (None, "") and named[7] == (None, "")


def test_same_normal_form_in_spark_and_plain(spark):
    texts = ["A  licence,\n© 2020 X\nOrganisation", "copyright notice stays", "(C) 1999", "Ünïcode—dash", "https://x.y/z & co"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", licenses.canonical("text").alias("c")).collect()
    assert all(r["c"] == licenses.plain(r["text"]) for r in rows)
    assert licenses.plain("copyright notice stays") == "copyright notice stays" and licenses.plain("(C) 1999 me\nrest") == "rest"


def test_own_table_and_empty_table(spark, monkeypatch):
    known = licenses.known_licenses(spark, [("X-1", "Do what you like."), ("X-0", "do WHAT you like"), ("none", "!!!")])
    assert [r["license_id"] for r in known.collect()] == ["X-0"]
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    got = licenses.scan(spark.createDataFrame([(1, "Do what you like", None)], DOCS), known).collect()
    assert [(r["license_id"], r["notices"]) for r in got] == [("X-0", "X-0")]
    assert licenses.scan(spark.createDataFrame([], DOCS), known).collect() == []
