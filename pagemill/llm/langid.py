"""Language identification by rank-order profiles (operator 1).

A text is lower-cased letters with one blank for every run of anything else, and a blank at both ends.  Its n-grams of 1
to 3 characters, taken inside words and their blanks, are ranked by frequency (ties by characters).  A language's
profile is the ``PROFILE`` most frequent n-grams of all its training texts.  The distance of a document to a language
is the sum, over the document's own most frequent n-grams, of how far out of place each is in the profile; an n-gram
the profile lacks counts ``PROFILE``.  The nearest language is predicted, the alphabetically first of equals.

Training counts are made where the texts lie, summed by Spark over (language, n-gram) and cut to the profile by rank.
Prediction is a pass over the documents without a shuffle; profiles are a few thousand rows.

Defined results: a null text, or one without letters, is ``und`` with score 0; texts are taken in pieces, so their
length costs no memory; without any training text every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored

PROFILE = 400
UNKNOWN = "und"
PIECE = 1 << 18
# Distinct n-grams kept in one task before their counts are handed on.
KEPT = 1 << 20
# Languages with a profile at most; what is sent to the tasks stays below it times PROFILE.
MAX_LANGUAGES = 2000
_BITS = 21
_table: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: its lower-case letter, or a blank for what is no letter."""
    global _table
    if _table is None:
        table = np.full(0x110000, 0x20, dtype=np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _table = table
    return _table


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text as numbers, piece by piece; nothing for a text without letters."""
    table, carry = letters(), np.array([0x20], dtype=np.int64)
    for at in range(0, len(text), PIECE):
        last = at + PIECE >= len(text)
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        stream = np.concatenate([carry, table[points], np.array([0x20] * last, dtype=np.int64)])
        old = len(carry)
        blank = stream == 0x20
        keep = np.ones(len(stream), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[:old] = True
        old_kept = old
        stream = stream[keep]
        blank = stream == 0x20
        # Only n-grams that end in a new character; none is blank in its middle, and no blank stands alone.
        ends = np.arange(old_kept, len(stream))
        one = stream[ends[~blank[ends]]]
        pairs = ends[ends >= 1]
        two = (stream[pairs - 1] << _BITS) | stream[pairs]
        threes = pairs[pairs >= 2]
        threes = threes[~blank[threes - 1]]
        three = (stream[threes - 2] << (2 * _BITS)) | (stream[threes - 1] << _BITS) | stream[threes]
        yield np.concatenate([one, two, three])
        carry = stream[-2:]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts."""
    found = [np.unique(g, return_counts=True) for g in grams(text or "")]
    if len(found) == 1:
        return found[0]
    return merged(found)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(values)).astype(np.int64)


def ranked(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent n-grams, most frequent first, ties by value."""
    if len(values) > n:
        # Values are ascending, so a stable sort by falling count breaks ties by value.
        return values[np.argsort(-counts, kind="stable")[:n]]
    return values[np.argsort(-counts, kind="stable")]


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: partial counts for each task; ``docs`` holds lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                values, counts = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for piece in grams(text.as_py() or ""):
                    own = np.unique(piece, return_counts=True)
                    held.setdefault(lang, []).append(own)
                    size += len(own[0])
                if size >= KEPT:
                    held = {k: [merged(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size >= KEPT // 2:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "lang string, gram long, n long")


def learn(docs: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its most frequent n-grams, over all rows of ``docs`` (lang, text) with a language and letters."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = count_grams(known).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # Rank inside 16 shares of a language first, so that no task sees all of its n-grams.
    share = W.partitionBy("lang", "share").orderBy(F.desc("n"), "gram")
    cut = counts.withColumn("share", F.pmod(F.xxhash64("gram"), F.lit(16))).withColumn(
        "r", F.row_number().over(share)).filter(F.col("r") <= profile)
    top = cut.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= profile)
    profiles = stored(top.select("lang", "gram", "r", "n"), "profiles")
    # Beyond the bound, the languages whose commonest n-gram counts most.
    kept = profiles.filter("r = 1").orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).select("lang")
    rows = profiles.join(kept, "lang", "left_semi").select("lang", "gram", "r").collect()
    found: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {lang: [g for _, g in sorted(v)] for lang, v in sorted(found.items())}


class Profiles:
    """Profiles as one table of ranks: n-gram x language."""

    def __init__(self, profiles: dict[str, list[int]], profile: int):
        self.languages = sorted(profiles)
        self.profile = profile
        self.grams = np.unique(np.array([g for v in profiles.values() for g in v], dtype=np.int64))
        self.ranks = np.full((len(self.grams), len(self.languages)), -1, dtype=np.int32)
        for column, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), column] = np.arange(len(profiles[lang]))

    def nearest(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin.

        The score is 1 - distance / largest possible distance; the margin how much farther the second language is.
        """
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        own = ranked(*counted(text), self.profile)
        if not len(own):
            return UNKNOWN, 0.0, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        hit = self.grams[at] == own
        ranks = self.ranks[at[hit]]
        apart = np.where(ranks < 0, self.profile, np.abs(ranks - np.flatnonzero(hit)[:, None]))
        distance = apart.sum(axis=0) + self.profile * int((~hit).sum())
        best = int(np.argmin(distance))
        farthest = self.profile * len(own)
        others = np.delete(distance, best)
        margin = float((others.min() - distance[best]) / farthest) if len(others) else 1.0
        return self.languages[best], float(1 - distance[best] / farthest), margin


def predict(docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred, score, margin; columns of these names are replaced."""
    kept = docs.drop("lang_pred", "score", "margin")
    result = kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "margin": F.lit(0.0)})
    text_at = result.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, profile)
        for batch in batches:
            found = [model.nearest(t.as_py()) for t in batch.column(text_at)]
            languages, scores, margins = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                names=batch.schema.names)

    return result.mapInArrow(run, result.schema)


def held_out() -> Column:
    """Rows a model of this module does not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id that is not held out."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def known_language(docs: DataFrame, least: float = 0.2, profile: int = PROFILE) -> DataFrame:
    """The rows of ``docs`` in some language learned from them; a null ``lang`` is filled with the prediction.

    Rejected are texts without letters and texts whose n-grams fit no profile: score under ``least``.  Where no language
    can be learned, as no row is labelled, there is nothing to fit, and every text with letters stays as it is.  Prose scores 0.4
    and more even where it is short, shouted or mixed.
    """
    profiles = learn(training_rows(docs), profile)
    if not profiles:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = docs.withColumns({f"_own_{i}": F.col(c) for i, c in enumerate(docs.columns) if c in ("lang_pred", "score", "margin")})
    found = predict(named, profiles, profile).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    out = [F.col(f"_own_{i}").alias(c) if c in ("lang_pred", "score", "margin") else
           F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for i, c in enumerate(docs.columns)]
    return found.select(*out)
