"""Derived WARC records: metadata and plain text of response records (operator 9).

Every response becomes two records that refer to it: a ``metadata`` record (``application/warc-fields``: the source's
headers and digest, title, lengths and outgoing links) and a ``conversion`` record (``text/plain``).  Ids are named from
the source's id and the kind of record, so that a second run gives the same records.  Pages are read once, where they
lie; nothing is shuffled.

Text is what stands outside tags, comments and script-like elements, with entities resolved; block elements end lines,
white space is collapsed and blank lines are left out.  The scan looks at every character once: an unclosed comment,
tag or script ends the text.

Defined results: a null payload is empty and gives records with an empty text; a null record id is named from the
target and payload; a null target or date is an empty header value, or ``UNDATED``; repeated rows give repeated records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDATED = "1970-01-01T00:00:00Z"
SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "block_digest string, source_digest string, header string, block string")
# Elements that end a line, and elements whose content is no text.
_LINES = frozenset((
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li "
    "main nav ol option p pre section table tbody td tfoot th thead title tr ul").split())
_HIDDEN = frozenset(("script", "style", "template", "noscript", "iframe", "textarea"))
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)")
_HREF = re.compile(r"""\bhref\s*=\s*("[^">]*"|'[^'>]*'|[^\s"'>]+)""", re.I)
_CLOSERS = {name: re.compile(f"</{name}", re.I) for name in _HIDDEN}
_BLANKS = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    """SHA-1 in base 32, the usual form of WARC digests."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(names))}>"


def read_page(page: str) -> tuple[str, str, list[str]]:
    """Plain text, title and link targets of a page."""
    parts: list[str] = []
    links: list[str] = []
    title: list[str] | None = None
    titles: list[str] = []
    at = 0
    while True:
        lt = page.find("<", at)
        piece = page[at:] if lt < 0 else page[at:lt]
        (parts if title is None else title).append(piece)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                break
            at = end + 3
            continue
        tag = _TAG.match(page, lt)
        if tag is None and not page.startswith(("<!", "<?", "</"), lt):
            (parts if title is None else title).append("<")
            at = lt + 1
            continue
        end = page.find(">", lt)
        if end < 0:
            break
        at = end + 1
        if tag is None:
            continue
        name, closing = tag.group(2).lower(), bool(tag.group(1))
        if name in _HIDDEN and not closing:
            closer = _CLOSERS[name].search(page, at)
            if closer is None:
                break
            at = closer.start()
            continue
        if name == "title":
            if title is not None:
                titles.append("".join(title))
            title = None if closing else []
        if name == "a" and not closing and (m := _HREF.search(page, tag.end(), end)):
            links.append(html.unescape(m.group(1).strip("\"'")).strip())
        if name in _LINES:
            (parts if title is None else title).append("\n")
    if title is not None:
        titles.append("".join(title))
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line), " ".join(html.unescape(" ".join(titles)).split()), [u for u in links if u]


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _header(kind: str, fields: list[tuple[str, str]], block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {_one_line(v)}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + "\r\n\r\n"


def derive(record: dict) -> Iterator[dict]:
    """The two records of one response: a dict of record_id, target_uri, date, http_header and payload."""
    payload = record["payload"] or ""
    raw = payload.encode("utf-8", "surrogatepass")
    uri, date = record["target_uri"] or "", record["date"] or UNDATED
    source = record["record_id"] or record_id("response", uri, payload)
    source_digest = digest(raw)
    text, title, links = read_page(payload)
    body = text.encode("utf-8", "surrogatepass")
    fields = [("source-record", source), ("source-digest", source_digest), ("source-length", str(len(raw)))]
    fields += [("source-header", line) for line in (record["http_header"] or "").splitlines() if line.strip()]
    fields += [("title", title), ("text-length", str(len(body))), ("text-digest", digest(body)), *(("outlink", u) for u in links)]
    notes = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields)
    for kind, content_type, block in (("metadata", "application/warc-fields", notes), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode("utf-8", "surrogatepass")
        own = {"record_type": kind, "record_id": record_id(kind, source, source_digest), "refers_to": source, "target_uri": uri,
               "date": date, "content_type": content_type, "block_digest": digest(data), "source_digest": source_digest, "block": block}
        own["header"] = _header(kind, [
            ("WARC-Record-ID", own["record_id"]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source),
            ("WARC-Block-Digest", own["block_digest"]), ("WARC-Source-Payload-Digest", source_digest), ("Content-Type", content_type)], data)
        yield own


def derivatives(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows per row of ``responses`` (record_id, target_uri, date, http_header, payload), with the ``keep`` columns."""
    keep = keep or []
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    need = ["record_id", "target_uri", "date", "http_header", "payload"]
    rows = responses.select(*[F.col(c).alias(f"kept_{c}") for c in keep], *[F.col(c).cast("string").alias(c) for c in need])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(len(keep) + i) for i in range(len(need))]
            for lo in range(0, batch.num_rows, 256):
                part = [c.slice(lo, 256).to_pylist() for c in columns]
                made = [r for values in zip(*part, strict=True) for r in derive(dict(zip(need, values, strict=True)))]
                twice = pa.array([lo + i // 2 for i in range(len(made))], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(twice) for i in range(len(keep))),
                     *(pa.array([r[n] for r in made], pa.string()) for n in names)],
                    names=[*(f"kept_{c}" for c in keep), *names])

    kept = "".join(f"`kept_{c}` {rows.schema[f'kept_{c}'].dataType.simpleString()}, " for c in keep)
    found = rows.mapInArrow(run, kept + SCHEMA)
    return found.select(*[F.col(f"kept_{c}").alias(c) for c in keep], *[F.col(n) for n in names])


def write_warc(records: DataFrame, folder: str) -> None:
    """WARC files, gzipped, one per task; a record ends with two line ends."""
    records.select(F.concat("header", "block", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option(
        "compression", "gzip").text(folder)


def response_id(*names: Column) -> Column:
    """An id for responses that come without one, named from columns."""
    h = F.md5(F.concat_ws("\x00", *[F.coalesce(n.cast("string"), F.lit("")) for n in names]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *sum(([F.substring(h, a, n), F.lit("-" if a < 21 else ">")] for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))), []))
