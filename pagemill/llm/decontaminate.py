"""Benchmark passages in documents, by SimHash of item-sized windows (operator 4).

A document is contaminated by an item when some window of as many words as the item has a weighted-shingle similarity
of ``percent`` or more to it.  Shingles are of five words and weigh as often as they occur: the similarity is the sum
of the smaller weights over the sum of the larger ones.  A document with fewer words than the item is one window.

1. Two windows of a and b shingles reach similarity s only with s / (1 + s) * (a + b) shingles in common.  Windows with
   fewer shingles known from *any* item cannot match one and are not fingerprinted; this loses nothing.
2. The others get a 64-bit SimHash over their words (a changed word costs five shingles but one word).
3. The items' fingerprints are indexed by four blocks of 16 bits.  Fingerprints within ``RADIUS`` = 19 bits differ in
   some block by at most 4, so each item is entered under all block values within 4 bits, and a look-up finds every
   fingerprint within the radius.
4. Exact weighted-shingle similarity decides.

Items are taken in slices of bounded size, so that the index sent to the tasks is bounded; a benchmark of several
slices passes over the documents once for each, writing what it found so far in between, so a task holds one slice.
Documents are not shuffled.

Words are compared without regard to case and normal form, over all of Unicode: items and texts are folded alike.

Defined results: null, empty and blank texts and items match nothing; an item of fewer than five words, which is no
whole shingle, matches only a document of exactly its words; a null item_id matches nothing; repeated items are found
each under its own id; columns named ``leak_items`` or ``leak_score`` are replaced.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .stored import stored

K = 5
RADIUS = 19
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 4
# Items, and bytes of their texts, in a slice.
SLICE_ITEMS, SLICE_BYTES = 1000, 4 << 20
_GATE_BITS = 22
# Words of a run of windows that is fingerprinted at once.
RUN_WORDS = 1 << 17


def folded(texts: pa.Array) -> pa.Array:
    """Texts as they are compared: case folded, in composed normal form.  ASCII stays, as words lower A-Z themselves."""
    return pa.array([
        t if t is None or t.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).casefold())
        for t in texts.to_pylist()], pa.large_string())


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)


def simhash(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit SimHash of the words in each window; a bit is set where more than half the words have it.

    ``starts`` rise.  Windows are taken in runs of neighbours of at most ``RUN_WORDS`` words, or one longer window, so
    memory follows the windows and not the text between them.
    """
    prints, at = np.empty(len(starts), dtype=np.uint64), 0
    apart = np.append(np.flatnonzero(np.diff(starts) > length) + 1, len(starts))
    while at < len(starts):
        lo = int(starts[at])
        stop = min(int(apart[np.searchsorted(apart, at, "right")]), max(at + 1, int(np.searchsorted(starts, lo + RUN_WORDS - length, "right"))))
        own = starts[at:stop] - lo
        words_ = hashes[lo : lo + int(own[-1]) + length]
        total = np.zeros((len(words_) + 1, 64), dtype=np.int32)
        np.cumsum(_bits(words_), axis=0, out=total[1:], dtype=np.int32)
        ones = total[own + length] - total[own]
        prints[at:stop] = np.packbits(2 * ones > length, axis=1).view(np.uint64).reshape(-1)
        at = stop
    return prints


class Items:
    """A slice of the benchmark, indexed."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray]):
        self.ids = np.array(ids, dtype=np.int64)
        self.lengths = np.array([len(h) for h in hashes])
        self.sizes = sorted({int(n) for n in self.lengths if n >= K})
        self.short = {h.tobytes(): [] for h in hashes if 0 < len(h) < K}
        for item, h in zip(ids, hashes, strict=True):
            if 0 < len(h) < K:
                self.short[h.tobytes()].append(item)
        self.shingles = [words.shingles(h, np.array([0, len(h)]), K)[0] if len(h) >= K else np.empty(0, np.uint64)
                         for h in hashes]
        self.known = np.unique(np.concatenate(self.shingles)) if self.shingles else np.empty(0, np.uint64)
        self.gate = np.zeros(1 << _GATE_BITS, dtype=bool)
        self.gate[self.known >> np.uint64(64 - _GATE_BITS)] = True
        self.prints = np.array([simhash(h, np.array([0]), len(h))[0] if len(h) else 0 for h in hashes], dtype=np.uint64)
        masks = np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1)
                          for c in combinations(range(BLOCK_BITS), r)], dtype=np.uint32)
        long_items = np.flatnonzero(self.lengths >= K).astype(np.int32)
        self.tables = []
        for b in range(BLOCKS):
            near = self.block(self.prints[long_items], b)[:, None] ^ masks[None, :]
            owner = np.repeat(long_items, len(masks))
            order = np.argsort(near.reshape(-1), kind="stable")
            offsets = np.searchsorted(near.reshape(-1)[order], np.arange((1 << BLOCK_BITS) + 1))
            self.tables.append((offsets, owner[order]))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)

    def is_known(self, values: np.ndarray) -> np.ndarray:
        hit = self.gate[values >> np.uint64(64 - _GATE_BITS)]
        at = np.flatnonzero(hit)
        if len(at):
            place = np.searchsorted(self.known, values[at])
            place[place == len(self.known)] = 0
            hit[at] = self.known[place] == values[at]
        return hit

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints differ in at most RADIUS bits: all of them."""
        pairs = []
        for b, (offsets, owner) in enumerate(self.tables):
            value = self.block(prints, b)
            n = offsets[value + 1] - offsets[value]
            window = np.repeat(np.arange(len(prints)), n)
            item = owner[np.repeat(offsets[value] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            pairs.append(window[near] * len(self.ids) + item[near])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.ids)), both % max(1, len(self.ids))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller weights over sum of the larger weights, a weight being a shingle's count."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    shared = int(np.minimum(ca[ia], cb[ib]).sum())
    return shared / (len(a) + len(b) - shared)


def _search(items: Items, hashes: np.ndarray, shingles: np.ndarray, known: np.ndarray, percent: int) -> tuple[list[int], float]:
    """Items of at least K words found in one document of at least K words, and the best similarity."""
    running = np.concatenate([[0], np.cumsum(known)])
    best: dict[int, float] = {}
    for size in items.sizes:
        length = min(size, len(hashes))
        a, b = length - K + 1, size - K + 1
        needed = -(-percent * (a + b) // (100 + percent))
        starts = np.flatnonzero(running[a:] - running[:-a] >= needed)
        if not len(starts):
            continue
        prints = simhash(hashes, starts, length)
        for window, item in zip(*items.within_radius(prints), strict=True):
            if items.lengths[item] == size and best.get(item, 0.0) < 1.0:
                at = starts[window]
                found = similarity(shingles[at : at + a], items.shingles[item])
                best[item] = max(best.get(item, 0.0), found)
    kept = {i: s for i, s in best.items() if 100 * s >= percent - 1e-9}
    return [int(items.ids[i]) for i in kept], max(kept.values(), default=0.0)


_built: dict[bytes, Items] = {}


def _key_of(ids: list[int], hashes: list[np.ndarray]) -> bytes:
    """A digest of all of a slice: ids, lengths and words."""
    digest = hashlib.sha256(np.array([len(ids), *ids, *map(len, hashes)], np.int64).tobytes())
    for own in hashes:
        digest.update(own.tobytes())
    return digest.digest()


def _items_of(key: bytes, ids: list[int], hashes: list[np.ndarray]) -> Items:
    """The index of a slice, built once in each Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(ids, hashes)
    return _built[key]


def _slices(benchmark: DataFrame) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "item_id IS NOT NULL AND text IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, -(-n // SLICE_ITEMS), -(-size // SLICE_BYTES))
    for i in range(slices):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).orderBy("item_id", "text").collect()
        hashes: list[np.ndarray] = []
        for _, found, offsets in words.word_hashes(folded(pa.array([r["text"] for r in part], pa.string()))):
            hashes.extend(found[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        yield [r["item_id"] for r in part], hashes


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with ``leak_items`` (sorted ids of the items found) and ``leak_score`` (best similarity, 0 if none)."""
    result = docs.drop("leak_items", "leak_score").withColumns({
        "leak_items": F.array().cast("array<long>"), "leak_score": F.lit(0.0)})
    text_at, schema = result.columns.index("text"), result.schema
    for number, (ids, hashes) in enumerate(_slices(benchmark)):
        if number:
            result = stored(result, "leaks")
        key = _key_of(ids, hashes)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, hashes=hashes, key=key) -> Iterator[pa.RecordBatch]:
            items = _items_of(key, ids, hashes)
            for batch in batches:
                n = len(batch.schema)
                found_items, scores = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
                for row, own, offsets in words.word_hashes(folded(batch.column(text_at))):
                    values, counts = words.shingles(own, offsets, K)
                    known = items.is_known(values)
                    ends = np.cumsum(counts)
                    hits = np.add.reduceat(np.concatenate([known, [False]]), ends - counts, dtype=np.int64)
                    hits[counts == 0] = 0
                    lengths = np.diff(offsets)
                    whole = np.flatnonzero((lengths > 0) & (lengths < K)) if items.short else ()
                    for r in np.flatnonzero(hits):
                        if lengths[r] < K:
                            continue
                        part = slice(ends[r] - counts[r], ends[r])
                        found, score = _search(items, own[offsets[r] : offsets[r + 1]], values[part], known[part], percent)
                        if found:
                            found_items[row + r] = sorted({*found_items[row + r], *found})
                            scores[row + r] = max(scores[row + r], score)
                    for r in whole:
                        found = items.short.get(own[offsets[r] : offsets[r + 1]].tobytes(), [])
                        if found:
                            found_items[row + r], scores[row + r] = sorted({*found_items[row + r], *found}), 1.0
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: n - 2], pa.array(found_items, pa.list_(pa.int64())), pa.array(scores, pa.float64())],
                    names=batch.schema.names)

        result = result.mapInArrow(run, schema)
    return result


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns."""
    return find_leaks(docs, benchmark, percent).filter(F.size("leak_items") == 0).select(
        *[c for c in docs.columns if c not in ("leak_items", "leak_score")])
