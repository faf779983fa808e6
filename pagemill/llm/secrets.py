"""Secrets in texts: fixed patterns, and strings that dictionary-primed compression finds new (operator 2).

Base spans are the leftmost non-overlapping matches of three patterns:

* ``assign``: a sensitive name, an optional quote, ``:`` or ``=``, an optional quote and a value of 8 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters together;
* ``hex``: 32 or more lower-case hexadecimal digits.

``novel`` spans come on top.  A candidate is a run of 16 or more token characters, dots inside it included, with a letter
and a digit, that lies on the line of a sensitive word, before or behind it, or within ``REACH`` characters of one; and
all of a PEM private key between its BEGIN and END lines (without an END line, the key lines that follow).  zstandard is primed with the identifier dictionary and with the
text around the candidate; the candidate's marginal compressed bytes are what it adds to an empty frame.  One that
still costs ``NOVELTY`` bytes a character is new to its surroundings and to the identifiers, and is reported.

The identifier dictionary is made of the most frequent identifiers near sensitive words in all texts, counted by Spark
and cut to ``IDENTIFIERS`` entries; it holds letters and underscores only, so that a secret that many copies repeat
does not become an identifier.

Spans count code points, end exclusive; those of different kinds may overlap.  A null text is empty; no text, no span.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
IDENTIFIERS, IDENTIFIER_LENGTH = 2000, 24
REACH, AROUND, NOVELTY = 48, 256, 0.5
MASK = "[secret]"
# Distinct identifiers counted in one task before the counts are handed on.
KEPT = 200_000

# Fixed patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SENSITIVE = re.compile(
    r"(?ai:password|passwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|authorization)")
WORDS = ("pass", "secret", "token", "key", "credential", "bearer", "authorization")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-]")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----\s*")
PEM_END = re.compile(r"\s*-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_LINES = re.compile(r"(?:[A-Za-z0-9+/=]{16,}\s+)*[A-Za-z0-9+/=]+")
IDENTIFIER = re.compile(r"[A-Za-z_]{3,%d}" % IDENTIFIER_LENGTH)


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    low = text.lower() if low is None else low
    found = []
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def marginal_bytes(candidate: str, around: str, identifiers: bytes) -> int:
    """Compressed bytes the candidate adds when zstandard is primed with the identifiers and the text around it."""
    primer = zstandard.ZstdCompressionDict(
        identifiers + b"\n" + around.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(
        level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(candidate.encode("utf-8", "surrogatepass"))) - len(packer.compress(b""))


def _private_keys(text: str) -> list[tuple[int, int]]:
    """What stands between the BEGIN and END lines of private keys."""
    found, at = [], 0
    while m := PEM.search(text, at):
        again = PEM.search(text, m.end())
        end = PEM_END.search(text, m.end(), again.start() if again else len(text)) or None
        lines = None if end else KEY_LINES.match(text, m.end())
        at = end.start() if end else lines.end() if lines else m.end()
        if at > m.end():
            found.append((m.end(), at))
        at = max(at, m.end())
    return found


def _contexts(text: str) -> list[tuple[int, int]]:
    """Lines of sensitive words, and ``REACH`` characters around the words; in order, not overlapping."""
    found: list[tuple[int, int]] = []
    line_end = -1
    for m in SENSITIVE.finditer(text):
        if m.end() > line_end:
            line_start, line_end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            line_end = len(text) if line_end < 0 else line_end
        lo, hi = min(line_start, max(0, m.start() - REACH)), max(line_end, m.end() + REACH)
        if found and lo <= found[-1][1]:
            found[-1] = found[-1][0], max(hi, found[-1][1])
        else:
            found.append((lo, hi))
    return found


def novel_spans(text: str, identifiers: bytes, low: str | None = None) -> list[tuple[int, int, str]]:
    """Candidates near a sensitive word that the primed compressor can't shorten."""
    low = text.lower() if low is None else low
    if not any(w in low for w in WORDS):
        return []
    keys = _private_keys(text)
    candidates = list(keys)
    done = k = 0
    for lo, hi in _contexts(text):
        # A run that begins before the context is taken whole.
        while lo > done and (text[lo - 1].isascii() and text[lo - 1].isalnum() or text[lo - 1] in "+/_=.-"):
            lo -= 1
        at = max(done, lo)
        while (c := CANDIDATE.search(text, at)) and c.start() < hi:
            at = done = c.end()
            while k < len(keys) and keys[k][1] <= c.start():
                k += 1
            inside = k < len(keys) and keys[k][0] < c.end()
            if not inside and any(x.isdigit() for x in c.group()) and any(x.isalpha() for x in c.group()):
                candidates.append(c.span())
    found = []
    for start, end in sorted(candidates):
        own = text[start:end]
        around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]
        if marginal_bytes(own, around, identifiers) >= NOVELTY * len(own):
            found.append((start, end, "novel"))
    return found


def _near(text: str) -> Iterator[str]:
    """Identifiers around the sensitive words of a text; text around several is read once."""
    low = text.lower()
    if not any(w in low for w in WORDS):
        return
    done = 0
    for m in SENSITIVE.finditer(text):
        lo, hi = max(done, m.start() - AROUND), m.end() + AROUND
        if hi > lo:
            yield from IDENTIFIER.findall(text, lo, hi)
        done = max(done, hi)


def identifier_dictionary(docs: DataFrame, text: str = "text") -> bytes:
    """The most frequent identifiers near sensitive words over all rows, most frequent last (nearest to the data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    counts.update(_near(value))
                if len(counts) >= KEPT:
                    yield out()
                    counts = Counter()
        yield out()

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(IDENTIFIERS).collect()
    return " ".join(r["word"] for r in reversed(top)).encode()


def scan(docs: DataFrame, identifiers: bytes) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, end, kind) in order; a column of this name is replaced."""
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    result = docs.drop("secret_spans").withColumn("secret_spans", F.array().cast(kind))
    text_at = result.columns.index("text")
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch.column(text_at):
                value = value.as_py() or ""
                low = value.lower()
                both = sorted([*base_spans(value, low), *novel_spans(value, identifiers, low)], key=_order)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in both])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, arrow)], names=batch.schema.names)

    return result.mapInArrow(run, result.schema)


def joined(spans) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, per row of ``scan``'s result."""
    span = F.col("secret_spans")
    base = F.filter(span, lambda s: s["kind"] != "novel")

    def count(kind: str):
        return F.size(F.filter(span, lambda s: s["kind"] == kind)).cast("long")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(span).alias("spans"), count("novel").alias("n_novel"))


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every stretch of the text that a span covers as ``MASK``; overlapping spans are one stretch.

    ``n_chars``, where there is one, counts the new text of the rows that changed.
    """
    identifiers = identifier_dictionary(docs)
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumn("_masked", F.lit(False))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = batch.column(text_at).to_pylist(), []
            for r, value in enumerate(texts):
                low = (value or "").lower()
                spans = [*base_spans(value or "", low), *novel_spans(value or "", identifiers, low)]
                changed.append(bool(spans))
                if spans:
                    texts[r] = masked(value, [(start, end) for start, end, _ in spans])
            columns = list(batch.columns[:-1])
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed)], names=batch.schema.names)

    found = rows.mapInArrow(run, rows.schema)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("_masked"), F.char_length("text")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)
