"""Derived WARC records."""

import base64
import gzip
import hashlib
import os
import time
from html.parser import HTMLParser

import pytest

from pagemill.llm import queries, warc

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

RESPONSES = "page_id long, record_id string, target_uri string, date string, http_header string, payload string, block string"
PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p {color: red}</style></head><body>
<!-- no > text --><h1>Head</h1><p>One <b>two</b>  three<br>four &lt;five&gt; 1 < 2</p><script>var x = "<p>no</p>";</SCRIPT>
<a href="/x?a=1&amp;b=2">link</a><a name=n>no link</a><a HREF=/bare>bare</a></body></html>"""
TEXT = "Head\nOne two three\nfour <five> 1 < 2\nlinkno linkbare"


def test_text_title_and_links():
    assert warc.read_page(PAGE) == (TEXT, "A & B", ["/x?a=1&b=2", "/bare"])
    assert warc.read_page("a<!-- open") == ("a", "", []) and warc.read_page("a<script>b") == ("a", "", [])
    assert warc.read_page("a<b") == ("a", "", []) and warc.read_page("") == ("", "", []) and warc.read_page("<title>t") == ("", "t", [])


def test_unclosed_markup_is_linear():
    for piece in ("<script", "<p", "<!--", "<a href=\"", "<", "<title>", "</p ", "<script>x</scrip"):
        start = time.perf_counter()
        warc.read_page(piece * 60_000)
        assert time.perf_counter() - start < 3, piece


def test_records_refer_to_their_source(spark):
    rows = [(1, "<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html", PAGE, "x"),
            (2, None, None, None, None, None, None), (2, None, None, None, None, None, None), (3, "<urn:uuid:3>", "http://b\r\nEvil: 1", None, "", "é" * 200_000, "y")]
    got = warc.derivatives(spark.createDataFrame(rows, RESPONSES), keep=["page_id", "block"])
    assert got.columns[:2] == ["page_id", "block"]
    made = warc.derivatives(spark.createDataFrame(rows, RESPONSES), keep=["page_id"]).collect()
    assert len(made) == 8 and got.count() == 8
    own = {r["record_type"]: r for r in made if r["page_id"] == 1}
    source = "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    assert own["conversion"]["block"] == TEXT and own["metadata"]["refers_to"] == own["conversion"]["refers_to"] == "<urn:uuid:1>"
    assert own["metadata"]["record_id"] != own["conversion"]["record_id"] and own["metadata"]["source_digest"] == source
    for line in ("source-header: Content-Type: text/html", "title: A & B", "outlink: /bare", f"source-digest: {source}"):
        assert line in own["metadata"]["block"].split("\r\n")
    for r in made:
        block = r["block"].encode()
        fields = dict(x.split(": ", 1) for x in r["header"].split("\r\n")[1:] if x)
        assert r["header"].startswith("WARC/1.1\r\n") and r["header"].endswith("\r\n\r\n") and fields["Content-Length"] == str(len(block))
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert fields["WARC-Refers-To"] == r["refers_to"] and "Evil" not in fields
    assert len({r["record_id"] for r in made if r["page_id"] == 2}) == 2


def test_files_read_back_as_records(spark, tmp_path):
    rows = [(i, f"<urn:uuid:{i}>", "http://a/", None, "", f"<p>page {i}\r\n\r\nmore</p>", "x") for i in range(20)]
    records = warc.derivatives(spark.createDataFrame(rows, RESPONSES))
    folder = str(tmp_path / "out")
    warc.write_warc(records, folder)
    found = []
    for path in (tmp_path / "out").glob("part-*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            n = int(head.rsplit(b"Content-Length: ", 1)[1])
            found.append((head + b"\r\n\r\n", rest[:n]))
            assert rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]
    assert sorted(found) == sorted((r["header"].encode(), r["block"].encode()) for r in records.collect())


def test_empty_table(spark):
    assert warc.derivatives(spark.createDataFrame([], RESPONSES)).collect() == []


class Reader(HTMLParser):
    """Text, title and links as the standard library's parser sees a page."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.titles, self.links, self.hidden, self.in_title = [], [], [], [], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in warc._HIDDEN:
            self.hidden.append(tag)
        if tag == "title":
            self.in_title = True
            self.titles.append("")
        if tag == "a" and not self.hidden:
            self.links += [v.strip() for k, v in attrs if k == "href" and v and v.strip()][:1]
        self.end_line(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.hidden.remove(tag)
        if tag == "title":
            self.in_title = False
        self.end_line(tag)

    def end_line(self, tag):
        if tag in warc._LINES and not self.hidden:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.titles[-1] += data
        elif not self.hidden:
            self.parts.append(data)

    def text(self):
        lines = (" ".join(line.split()) for line in "".join(self.parts).split("\n"))
        return "\n".join(line for line in lines if line)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
def test_query_equals_a_parser_on_every_page(spark):
    """Both records of each page, from the page alone: text, title, links, lengths, digests and what refers to what."""
    def sha1(text):
        return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = queries.op9_warc_derivatives(spark, SF_DIR).collect()
    assert len(got) == 2 * len(pages) and {(r["page_id"], r["record_type"]) for r in got} == {(p, k) for p in pages for k in ("metadata", "conversion")}
    for r in got:
        page = pages[r["page_id"]]["html"] or ""
        want = Reader(page)
        plain = hashlib.md5(f"{r['page_id']}\x00{pages[r['page_id']]['url'] or ''}".encode()).hexdigest()
        assert r["refers_to"].replace("-", "") == f"<urn:uuid:{plain}>" and r["source_digest"] == sha1(page)
        assert r["target_uri"] == (pages[r["page_id"]]["url"] or "") and r["block_digest"] == sha1(r["block"])
        if r["record_type"] == "conversion":
            assert r["block"] == want.text()
            continue
        lines = [line.split(": ", 1) for line in r["block"].split("\r\n") if line]
        fields = {}
        for name, value in ((p[0], p[1] if len(p) > 1 else "") for p in lines):
            fields.setdefault(name.rstrip(":"), []).append(value)
        assert fields.get("outlink", []) == [" ".join(u.split()) for u in want.links]
        assert fields["title"] == [" ".join(" ".join(want.titles).split())]
        assert fields["source-length"] == [str(len(page.encode()))] and fields["text-length"] == [str(len(want.text().encode()))]
        assert fields["source-digest"] == [sha1(page)] and fields["text-digest"] == [sha1(want.text())] and fields["source-record"] == [r["refers_to"]]
