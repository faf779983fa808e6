"""Untrusted text (B11-B13): pattern scans and envelopes, all narrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.lineage import stored
from ..functions.text import contains_any, strip, truthy
from ..functions.workers import ship


# What a match needs: one of these words, and one of these letters at its start.  Most texts have none of the
# words, and most positions of the others none of the letters.
_NEEDED = {
    "instruction_override": (["IGNORE", "DISREGARD", "FORGET", "OVERRIDE"], "iIdDfFoO"),
    "system_prompt_access": (["PROMPT", "MESSAGE", "INSTRUCTION"], "sSdDrR"),
    "credential_access": (["ID_RSA", "API", "TOKEN", "PASSWORD", "CREDENTIAL", "SECRET"], "~iIaAtTpPcCsS"),
    "tool_execution": (["SHELL", "COMMAND", "TOOL", "BASH", "CURL", "PYTHON"], "rReEcCuU"),
    "data_exfiltration": (["SEND", "UPLOAD", "EXFILTRATE", "POST", "LEAK"], "sSuUeEpPlL"),
}


def with_signals(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add the array of signals found in ``text``."""
    # The four letters beyond ASCII that equal an ASCII letter when case is ignored.
    plain = text
    for letter, ascii_letter in [("ſ", "s"), ("K", "K"), ("ı", "i"), ("İ", "I")]:
        plain = F.replace(plain, F.lit(letter), F.lit(ascii_letter))
    # Plain ASCII has none of them, and one count of characters is cheaper than four searches.
    plain = F.when(F.octet_length(text) != F.char_length(text), plain).otherwise(text)
    staged = df.withColumn("_plain", plain).withColumn("_upper", F.upper("_plain"))
    found = []
    for name, pattern in rules.INJECTION_SIGNALS:
        words, heads = _NEEDED[name]
        hit = contains_any(F.col("_upper"), words) & F.col("_plain").rlike(f"(?=[{heads}])(?isU:{pattern})")
        found.append(F.when(hit, F.lit(name)))
    return staged.withColumn(out, F.array_compact(F.array(*found))).drop("_plain", "_upper")


def injection_risk(signals: Column) -> Column:
    override = F.array_contains(signals, "instruction_override")
    actions = F.size(F.array_intersect(signals, F.array(*[F.lit(s) for s in rules.SENSITIVE_SIGNALS])))
    return (
        F.when(F.size(signals) == 0, "none")
        .when(override & (actions > 0), "high")
        .when(override | (actions >= 2), "medium")
        .otherwise("low")
    )


def scan_injection(df: DataFrame, text: str = "text") -> DataFrame:
    """``injection_signals`` (fixed order) and ``injection_risk``."""
    return with_signals(df, F.coalesce(F.col(text), F.lit("")), "injection_signals").withColumn(
        "injection_risk", injection_risk(F.col("injection_signals")))


def boundary_id(text: Column) -> Column:
    """First counter whose marks do not occur in the text; a text with n marks rules out n counters at most."""
    def digest(counter: Column) -> Column:
        return F.substr(F.sha2(F.concat(counter.cast("string"), F.lit("\0"), text), 256), F.lit(1), F.lit(16))

    def used(d: Column) -> Column:
        return text.contains(F.concat(F.lit(f"{rules.BEGIN_MARK} boundary="), d)) | text.contains(
            F.concat(F.lit(f"{rules.END_MARK} boundary="), d))

    # A mark can only occur when its fixed part does, so most texts need one digest.
    marked = contains_any(text, [rules.BEGIN_MARK, rules.END_MARK])
    marks = F.size(F.split(text, " boundary=")) - 1
    free = F.filter(F.transform(F.sequence(F.lit(0), marks), digest), lambda d: ~used(d))
    return F.when(~marked, digest(F.lit(0))).otherwise(F.get(free, F.lit(0)))


def json_ascii(text: Column) -> Column:
    r"""A JSON string literal with everything but printable ASCII escaped."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        out = None
        for raw, code in short.items():
            out = F.when(c == raw, code) if out is None else out.when(c == raw, code)
        return out.when(c.rlike("^[ -~]$"), c).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    plain = text.rlike(r"^[ !#-\[\]-~]*$")
    body = F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def wrap_untrusted(df: DataFrame, text: str = "text", url: str | None = None, out: str = "wrapped") -> DataFrame:
    """Text inside a marked envelope.  ``wrap_error`` names rows whose boundary could not be made unique."""
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = with_signals(df, body, "_signals").withColumn("boundary_id", boundary_id(body))
    header = [
        *[F.lit(line) for line in rules.ENVELOPE_INTRO],
        F.lit(f"content_trust: {rules.TRUST_LABEL}"),
        F.concat(F.lit("prompt_injection_risk: "), injection_risk(F.col("_signals"))),
        F.concat(F.lit("prompt_injection_signals: "),
                 F.coalesce(truthy(F.array_join("_signals", ", ")), F.lit("none"))),
    ]
    if url:
        # concat_ws leaves null parts out, so rows without a URL have no such line.
        header.append(F.concat(F.lit("source_url: "), json_ascii(truthy(F.col(url)))))
    mark = F.concat(F.lit(" boundary="), F.col("boundary_id"))
    wrapped = F.concat(
        F.concat_ws("\n", *header), F.lit("\n\n"), F.lit(rules.BEGIN_MARK), mark, F.lit("\n"), body, F.lit("\n"),
        F.lit(rules.END_MARK), mark, F.lit("\n"))
    return (
        scanned.withColumn(out, wrapped)
        .withColumn("wrap_error", F.when(F.col("boundary_id").isNull(), "boundary_collision"))
        .drop("_signals")
    )


# The host pattern, tried for a bare host only where a run of name characters (or the rest of one) begins: a long run
# without a dot then costs one pass instead of one per character.
_HOST_SCAN = rules.HOST_IN_TEXT.replace("(?i)", "(?iU)").replace(r"[\w-]+\.", r"(?:(?<![\w-])|\G)[\w-]++\.")


# Longest part of a deny word that is looked up; shorter words are looked up whole.
ANCHOR = 5


# Bits of the map that says which parts may be anchors; a part it wrongly lets through is dropped by the join.
_BITS = 22


def _buckets(data: np.ndarray, size: int) -> np.ndarray:
    """A place in the map for each run of ``size`` bytes."""
    n = len(data) - size + 1
    value = np.full(n, size, np.uint64)
    for j in range(size):
        value = (value ^ data[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value >> np.uint64(64 - _BITS)


# Bytes looked at together, besides the last of a run.
_PIECE = 1 << 20


def _parts_met(low: pa.Array, sizes: list[int], known: np.ndarray) -> list[list[str] | None]:
    """For each text the distinct runs of ``sizes`` bytes that may be anchors by the map ``known``."""
    low = low.fill_null("").cast(pa.large_string())
    _, offsets, buffer = low.buffers()
    ends = np.frombuffer(offsets, np.int64)[low.offset : low.offset + len(low) + 1]
    first, last = int(ends[0]), int(ends[-1])
    data, met = np.frombuffer(buffer or b"", np.uint8), {}
    for at in range(first, last, _PIECE):
        for size in sizes:
            piece = data[at : min(at + _PIECE + size - 1, last)]
            if len(piece) < size:
                continue
            place = _buckets(piece, size)
            starts = at + np.flatnonzero(known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            rows = np.searchsorted(ends, starts, "right") - 1
            # Runs of whole characters inside one text.
            stops = starts + size
            begins = lambda i: (i >= last) | (data[np.minimum(i, last - 1)] & 0xC0 != 0x80)
            inside = (stops <= ends[rows + 1]) & begins(starts) & begins(stops)
            for row, start in zip(rows[inside].tolist(), starts[inside].tolist(), strict=True):
                met.setdefault(row, set()).add(data[start : start + size].tobytes())
    return [[p.decode("utf-8", "replace") for p in met[r]] if r in met else None for r in range(len(low))]


def _denied_lines(rows: DataFrame, deny: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _i, line, _denied: lines that hold a word of the table ``deny`` (word, rank), with the first by rank.

    Each word is entered under one of its parts of ``ANCHOR`` characters, the one fewest words share.  A map of fixed
    size, sent to all tasks, tells where a line may hold such a part, in time that follows its length; the parts found
    are joined to the words, and only lines that hold a word's part are searched for the word.
    """
    words = deny.filter(truthy("word").isNotNull()).groupBy(F.lower("word").alias("_low")).agg(F.min(F.struct("rank", "word")).alias("_w"))
    size = F.least(F.lit(ANCHOR), F.length("_low"))
    parts = words.withColumn("_part", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_low") - size + 1), lambda i: F.substring(F.col("_low"), i, size)))))
    shared = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    anchors = parts.join(shared, "_part").groupBy("_low").agg(F.min(F.struct("_n", "_part")).alias("_a"), F.first("_w").alias("_w"))
    anchors = stored(anchors.select(F.col("_a._part").alias("_part"), "_low", "_w"), "anchors")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(len(p), int(_buckets(np.frombuffer(p, np.uint8), len(p))[0])) for p in (x.encode() for x in batch.column(0).to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()) for c in zip(*found, strict=True)] or [pa.array([], pa.int32())] * 2, ["size", "place"])

    # Five characters have twenty bytes at most, and a size has as many places as the map.
    ship(rows.sparkSession)
    entered = anchors.select("_part").distinct().mapInArrow(places, "size int, place int")
    sizes = [r[0] for r in entered.select("size").distinct().collect()]
    known = np.zeros(1 << (_BITS - 3), np.uint8)
    taken = entered.groupBy(F.expr("place div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, place % 8))").alias("bits"))
    for byte, bits in taken.collect():
        known[byte] = bits
    own = [*keys, "_i", "line"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _parts_met(batch.column("_low"), sizes, known)
            hits = [r for r, p in enumerate(parts) if p]
            held = batch.take(pa.array(hits, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(held.column(c) for c in own), pa.array([parts[r] for r in hits], pa.list_(pa.string()))], names=[*own, "_parts"])

    lines = rows.select(*own, F.lower("line").alias("_low"))
    kinds = T.StructType([*rows.select(*own).schema, T.StructField("_parts", T.ArrayType(T.StringType()))])
    met = lines.mapInArrow(meet, kinds).withColumn("_part", F.explode("_parts")).drop("_parts")
    hits = met.join(anchors, "_part").filter(F.contains(F.lower("line"), F.col("_low")))
    return hits.groupBy(*keys, "_i", "line").agg(F.min("_w")["word"].alias("_denied"))


def scan_lines(df: DataFrame, text: str = "text", deny: list[str] | DataFrame | None = None,
               allow_hosts: list[str] | None = None, exempt_markers: list[str] | None = None,
               keys: list[str] | None = None) -> DataFrame:
    """Violations per line as (keys, line_no, kind, hit), at most one per line.

    ``deny`` substrings come first (in list order, any case); otherwise the first host that is not allowed.  A table of
    them (word, rank) may be of any length; then ``keys`` have to tell documents apart.
    """
    table, deny = (deny, None) if isinstance(deny, DataFrame) else (None, deny)
    allowed = [h.lower() for h in (rules.NEUTRAL_HOSTS if allow_hosts is None else allow_hosts)]
    keys = keys or [c for c in df.columns if c != text]
    unified = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    for end in "\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029":
        unified = F.replace(unified, F.lit(end), F.lit("\n"))
    lines = F.split(unified, "\n")
    # A document without any deny word and without the characters of a host has no such line.
    suspect = F.col(text).rlike(r"\.\S|://")
    if deny:
        suspect = suspect | contains_any(F.lower(text), [d.lower() for d in deny])
    rows = (df if table is not None else df.filter(suspect)).select(*keys, F.posexplode_outer(lines).alias("_i", "line"))
    if exempt_markers:
        rows = rows.filter(~contains_any(F.col("line"), exempt_markers))
    lowered = F.lower("line")
    denied = F.lit(None).cast("string")
    for d in reversed(deny or []):
        denied = F.when(lowered.contains(d.lower()), d).otherwise(denied)
    found = F.transform(
        F.regexp_extract_all(F.col("line"), F.lit(_HOST_SCAN), F.lit(0)),
        lambda u: F.regexp_replace(F.lower(u), r"^.*?//", ""))
    # A host has a dot before a letter, or a scheme; lines without either skip the costly search.
    found = F.when(F.col("line").rlike(r"\.\S|://"), found)
    foreign = F.filter(
        found,
        lambda h: ~h.isin(allowed) & ~h.endswith(".example.com") & ~h.endswith(".example.org"))
    judged = rows.withColumn("_denied", denied).withColumn("_host", F.get(foreign, F.lit(0)))
    if table is not None:
        listed = stored(_denied_lines(rows, table, keys), "denied")
        line = [*keys, "_i"]
        # Lines without a word, which are few where hosts are looked for.
        hosts = judged.filter("_host IS NOT NULL").join(listed.select(*line), line, "left_anti")
        judged = hosts.select(*line, "line", "_denied", "_host").unionByName(
            listed.select(*line, "line", "_denied", F.lit(None).cast("string").alias("_host")))
    return (
        judged.filter(F.col("_denied").isNotNull() | F.col("_host").isNotNull())
        .select(
            *keys,
            (F.col("_i") + 1).alias("line_no"),
            F.when(F.col("_denied").isNotNull(), "deny").otherwise("host").alias("kind"),
            F.coalesce("_denied", "_host").alias("hit"),
            strip("line").alias("line"),
        )
    )
