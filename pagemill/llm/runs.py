"""Periodic runs of words and texts without their repeats (operator 13).

A run is a stretch of words with smallest period q, at least ``max(LEAST, POWER * q)`` words long, that no neighbouring
word extends with the same period.  All runs of a text are found, of any period:

1. Words get numbers (equal words, equal numbers; case counts).
2. In a run every five words that follow each other come again one period later, so a stretch around five words that
   come once in it holds no run over them.  Texts fall into stretches by that, again and again while a pass takes a
   quarter of the words away.  Most prose ends here; nothing is lost, since only runs of ``LEAST`` words or more are
   asked for and each lies in one stretch with all its neighbours.
3. A stretch gets two suffix trees by Ukkonen's construction, of itself and of its reversal.  An Euler tour of each, with
   range minima over blocks, answers in constant time how far the words from two positions on (or back) agree.
4. The trees' leaves in order of words, and in the order turned round, give at every position the longest Lyndon word
   under both orders.  Each run starts a Lyndon root at some position under one of them, so extending these candidates
   in both directions by the trees' answers finds every run; a Lyndon root is primitive, so its length is the smallest
   period.

A text is worked on whole in one task, in time and memory in proportion to its words: tens of bytes a word where nothing
repeats, about 900 bytes for each word of a stretch while its trees are built.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text; rows keep their number,
so equal rows and null ids come back as often as they came in; other columns are not read.  Runs may overlap; ties need
no rule, as a run is told by start, length and period.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fewest words of a run, and fewest repeats of its period.
LEAST, POWER = 6, 4
# Words that come again one period later wherever a run of six words and four periods covers them.
GRAM = 5
# Bytes of a text that are split at once.
PIECE = 4 << 20
# Tour entries in a block of the range minima.
BLOCK = 32
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(text: str) -> tuple[np.ndarray, list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as numbers, and the distinct words by number."""
    data, known, parts, at = text.encode("utf-8", "surrogatepass"), _Numbers(), [], 0
    while at < len(data):
        stop = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = stop.start() if stop else len(data)
        # Without an argument, bytes are split at exactly the white space above.
        words = data[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), list(known)


def repeated_stretches(numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    """[start, end) of stretches that hold every run; neighbours may share up to three words, never a run."""
    factors = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
    pending = [(0, len(numbers))]
    while pending:
        lo, hi = pending.pop()
        if hi - lo < LEAST:
            continue
        own, n = numbers[lo:hi].astype(np.uint64) + np.uint64(1), hi - lo - GRAM + 1
        grams = own[:n] * factors[0]
        for k in range(1, GRAM):
            grams ^= (grams >> np.uint64(29))
            grams = grams * factors[k] + own[k : n + k]
        order = np.argsort(grams)
        same = np.diff(grams[order]) == 0
        again = np.zeros(n, dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        kept = int(again.sum())
        if not kept:
            continue
        if 4 * kept > 3 * n:
            yield lo, hi
            continue
        edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
        pending.extend((lo + int(a), lo + int(b) + GRAM - 1) for a, b in zip(edges[::2], edges[1::2], strict=True))


class SuffixTree:
    """The suffix tree of a list of positive numbers, closed by a 0.

    ``start`` and ``end`` bound each node's edge in the text, ``parent`` its parent, and ``leaf`` is the position its
    suffix begins at, or -1 for inner nodes; node 0 is the root.
    """

    def __init__(self, numbers: list[int]):
        text = [*numbers, 0]
        size, width = len(text), max(text) + 1
        start, end, link, leaf = [0], [0], [0], [-1]
        child: dict[int, int] = {}
        node = edge = length = waiting = leaves = 0
        for i, word in enumerate(text):
            waiting += 1
            fresh = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    leaf.append(leaves)
                    leaves += 1
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    first = start[below]
                    span = end[below] - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[first + length] == word:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    middle = len(start)
                    start += (first, i)
                    end += (first + length, size)
                    link += (0, 0)
                    leaf += (-1, leaves)
                    leaves += 1
                    child[key] = middle
                    child[middle * width + word] = middle + 1
                    start[below] = first + length
                    child[middle * width + text[first + length]] = below
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.size, self.leaf = size, leaf
        # Children in order of (parent, word).
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        self.words = (keys[order] % width).tolist()
        self.children = below[order].tolist()
        self.first = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()
        self.span = (np.array(end) - np.array(start)).tolist()

    def euler_tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text depth at each step of the tour, the step at which each suffix's leaf is met, and suffixes in order."""
        first, children, span, leaf = self.first, self.children, self.span, self.leaf
        depth, tour, met, suffixes = [0] * len(span), [], [0] * self.size, []
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            own = depth[node]
            suffix = leaf[node]
            if suffix >= 0:
                met[suffix] = len(tour)
                suffixes.append(suffix)
            else:
                back = ~node
                for below in reversed(children[first[node] : first[node + 1]]):
                    depth[below] = own + span[below]
                    stack += (back, below)
            tour.append(own)
        return np.array(tour, np.int32), np.array(met, np.int64), np.array(suffixes, np.int64)

    def turned_suffixes(self) -> np.ndarray:
        """Suffixes in order of words turned round; the end of the text still comes before every word."""
        first, children, words, leaf, suffixes, stack = self.first, self.children, self.words, self.leaf, [], [0]
        while stack:
            node = stack.pop()
            if leaf[node] >= 0:
                suffixes.append(leaf[node])
                continue
            lo, hi = first[node], first[node + 1]
            if words[lo] == 0:
                stack += children[lo + 1 : hi]
                stack.append(children[lo])
            else:
                stack += children[lo:hi]
        return np.array(suffixes, np.int64)


class Agreement:
    """How many numbers agree from two positions on, by the depth of two leaves' lowest common ancestor."""

    def __init__(self, tour: np.ndarray, met: np.ndarray):
        blocks = -(-len(tour) // BLOCK)
        self.met = met
        self.tour = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.tour[: len(tour)] = tour
        grid = self.tour.reshape(blocks, BLOCK)
        self.ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [grid.min(axis=1)]
        while (1 << len(self.levels)) <= blocks:
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left, right = np.minimum(self.met[a], self.met[b]), np.maximum(self.met[a], self.met[b])
        low, high = left // BLOCK, right // BLOCK
        found = np.minimum(self.behind[left], self.ahead[right])
        inside = np.flatnonzero(low == high)
        if len(inside):
            at, stop = left[inside], right[inside]
            least = self.tour[at]
            for step in range(1, BLOCK):
                least = np.minimum(least, self.tour[np.minimum(at + step, stop)])
            found[inside] = least
        between = np.flatnonzero(high - low > 1)
        if len(between):
            at, stop = low[between] + 1, high[between]
            level = np.frexp((stop - at).astype(np.float64))[1] - 1
            for k in np.unique(level):
                own = np.flatnonzero(level == k)
                table = self.levels[k]
                least = np.minimum(table[at[own]], table[stop[own] - (1 << int(k))])
                found[between[own]] = np.minimum(found[between[own]], least)
        return found


def _lyndon_lengths(suffixes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each position on: up to the next smaller suffix."""
    n = len(suffixes) - 1
    rank = [0] * (n + 1)
    for place, suffix in enumerate(suffixes.tolist()):
        rank[suffix] = place
    following = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        own, j = rank[i], i + 1
        while rank[j] > own:
            j = following[j]
        following[i] = j
    return np.array(following[:n], np.int64) - np.arange(n)


def runs_of_stretch(numbers: np.ndarray) -> np.ndarray:
    """start, length, period of every run of a stretch, sorted."""
    n = len(numbers)
    dense = np.unique(numbers, return_inverse=True)[1] + 1
    tree = SuffixTree(dense.tolist())
    tour, met, suffixes = tree.euler_tour()
    periods = np.concatenate([_lyndon_lengths(suffixes), _lyndon_lengths(tree.turned_suffixes())])
    del tree
    starts = np.tile(np.arange(n), 2)
    fits = POWER * periods <= n
    starts, periods = starts[fits], periods[fits]
    onward = Agreement(tour, met)(starts, starts + periods)
    # The end mark agrees with itself only.
    tour, met, _ = SuffixTree(dense[::-1].tolist()).euler_tour()
    back = Agreement(tour, met)(n - starts, n - starts - periods)
    found = np.stack([starts - back, back + periods + onward, periods], axis=1)
    found = found[found[:, 1] >= np.maximum(LEAST, POWER * periods)]
    return np.unique(found, axis=0)


def runs(numbers: np.ndarray) -> np.ndarray:
    """start, length, period of every run of a text's word numbers, by start and period."""
    found = [own + [lo, 0, 0] for lo, hi in repeated_stretches(numbers) if len(own := runs_of_stretch(numbers[lo:hi]))]
    if not found:
        return np.empty((0, 3), np.int64)
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def repeated_tail(doc_id: object, n: int) -> np.ndarray | None:
    """Word numbers of a text a tenth of the documents is turned into: from some word on, its start over and over."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def find_runs(docs: DataFrame, rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed, for every row of (doc_id, text).

    ``rewrite`` may name, by document and number of words, the words that stand for the text's own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            at, size = 0, 0
            counts, lists, collapsed = [], [], []
            for r in range(batch.num_rows):
                text = batch.column(1)[r].as_py() or ""
                numbers, words = numbered(text)
                order = rewrite(batch.column(0)[r].as_py(), len(numbers)) if rewrite else None
                if order is not None:
                    numbers = numbers[order]
                found = runs(numbers)
                kept = numbers[kept_words(len(numbers), found)] if len(found) else numbers
                counts.append(len(numbers))
                lists.append(found)
                collapsed.append(b" ".join(map(words.__getitem__, kept.tolist())))
                size += len(text)
                # Texts are handed on before they fill the worker.
                if size > PIECE or r == batch.num_rows - 1:
                    flat = np.concatenate(lists)
                    edges = np.cumsum([0, *(len(own) for own in lists)])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(at, len(counts)), pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(run))),
                        pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                    at, size, counts, lists, collapsed = r + 1, 0, [], [], []

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        work, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and the kept words."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
