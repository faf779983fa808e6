"""Words, shingles and min-max signatures of whole texts, vectorised over Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  Every word gets a 64-bit hash, a shingle
is a hash of ``k`` word hashes in a row; a text of fewer than ``k`` words is one shingle of all its words, and a text
without words (or null) has none.  Work goes on in pieces of about a megabyte, so memory does not follow the length of
a text beyond 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_CODE[65:91] += np.uint64(32)
_CODE[_SPACE] = 0
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """P^0, P^1, ... and their inverses modulo 2^64, for offsets inside a piece."""
    global _powers
    if _powers is None:
        both = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            table = np.full(PIECE + 1, base, dtype=np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _raw(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and unmixed hash of each word of a piece; a word ends where a row ends."""
    powers, inverses = _power_tables()
    letter = ~_SPACE[data]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[:1] = False
    before[row_starts[row_starts < len(data)]] = False
    starts = np.flatnonzero(letter & ~before)
    if not len(starts):
        return starts, starts, np.empty(0, dtype=np.uint64)
    sums = np.add.reduceat(_CODE[data] * powers[: len(data)], starts)
    lengths = np.add.reduceat(letter, starts, dtype=np.int64)
    return starts, lengths, sums * inverses[starts]


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text longer than a piece; a word may cross pieces."""
    done, open_word = [], None
    first = np.zeros(1, dtype=np.int64)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        starts, lengths, raw = _raw(piece, first)
        if open_word is not None:
            value, length = open_word
            if len(starts) and starts[0] == 0:
                raw[0] = (value + int(raw[0]) * pow(_P, length, 1 << 64)) & _MASK
                lengths[0] += length
            else:
                done.append(np.array([value], dtype=np.uint64))
            open_word = None
        if len(starts) and not _SPACE[piece[-1]]:
            open_word = (int(raw[-1]), int(lengths[-1]))
            raw = raw[:-1]
        done.append(raw)
    if open_word is not None:
        done.append(np.array([open_word[0]], dtype=np.uint64))
    return np.concatenate(done)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8), at


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets per row) for groups of rows of about a megabyte."""
    if not len(texts):
        return
    data, at = _bytes_of(texts)
    row, rows = 0, len(at) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
        lo, hi = int(at[row]), int(at[last])
        if hi - lo > PIECE:
            hashes = _long_text(data[lo:hi])
            offsets = np.array([0, len(hashes)])
        else:
            bounds = at[row : last + 1] - lo
            starts, _, hashes = _raw(data[lo:hi], bounds[:-1])
            offsets = np.searchsorted(starts, bounds)
        yield row, mix(hashes), offsets
        row = last


def _places(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each position on, and how many shingles each row has.

    Shingles of a row are in text order; rows follow each other.
    """
    counts = np.diff(offsets)
    n_shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    place = _places(k)
    if len(hashes) >= k:
        rolling = hashes[: len(hashes) - k + 1] * place[0]
        for j in range(1, k):
            rolling = rolling + hashes[j : len(hashes) - k + 1 + j] * place[j]
    else:
        rolling = np.empty(0, dtype=np.uint64)
    whole = np.zeros(len(hashes), dtype=np.uint64)
    whole[: len(rolling)] = rolling
    short = np.flatnonzero((counts > 0) & (counts < k))
    for r in short:
        own = hashes[offsets[r] : offsets[r + 1]]
        whole[offsets[r]] = np.sum(own * place[: len(own)], dtype=np.uint64) + np.uint64(len(own))
    keep = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts) < np.repeat(n_shingles, counts)
    return mix(whole[keep]), n_shingles


def distinct_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, rows behind each other, and their numbers."""
    ends = np.cumsum(counts)
    rows = [np.unique(values[e - c : e]) if c else values[:0] for e, c in zip(ends, counts, strict=True)]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    return (np.concatenate(rows) if rows else values[:0]), sizes


def min_max_signature(values: np.ndarray, counts: np.ndarray, permutations: int) -> np.ndarray:
    """Rows x 2*permutations: under each permutation the smallest and the largest value of the row's set.

    One hash evaluation gives two signature values, each equal for two sets with the probability of their Jaccard
    similarity.  Rows of empty sets are left out by the caller: every count must be positive.
    """
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), 2 * permutations), dtype=np.uint32)
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for p in range(permutations):
        v = (values ^ seeds[2 * p]) * (seeds[2 * p + 1] | np.uint64(1))
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v >>= np.uint64(32)
        out[:, 2 * p] = np.minimum.reduceat(v, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, starts)
    return out
