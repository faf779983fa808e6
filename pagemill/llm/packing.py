"""Packing of token lists into sequences by best fit and swap-based local search (operator 12).

1. ``token_pieces`` encodes whole texts, each distinct word once (see :mod:`.bpe`), closes every document with an end id,
   and cuts only documents longer than a sequence.
2. ``pack`` deals pieces to groups of about ``GROUP`` by a hash of the row they are written in, so no group follows any
   key.  In a group pieces go, longest first, to the sequence they leave the least room in (best fit decreasing).
3. While a group has more sequences than its tokens need, sequences with room, the emptiest first, give their pieces
   away: one moves into room elsewhere, one is exchanged for a shorter one, one for two shorter ones together, or two for
   a shorter one, whichever leaves the receiver the least room.  Each step moves tokens to the fuller side, so the sum of
   squared fills grows and the search ends; sequences that run empty are gone.
4. The emptiest sequence of each group goes to the next round, which packs all of these in far fewer groups, until one
   group is left.  So the loss against packing all at once does not follow the number of groups.

Every group holds a bounded number of pieces, and the number of groups follows the table.

Defined results: a null or empty text is the end id alone; a null id stays null; equal rows are packed each for itself;
in ``pack`` a null length counts as 0, a piece of length 0 takes no room, and a piece longer than a sequence has one for
itself; ties are settled by the order of rows as they were written; other columns of ``pieces`` come back beside the new
ones.  ``sequence_id`` and ``offset`` are the operator's own names: columns of these names are replaced.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoded_texts
from .stored import stored

# Pieces of a group, on average.
GROUP = 1 << 15
# Exchanges of the local search in a group, for each of its pieces.
EXCHANGES = 2
# Receivers an exchange looks at for each room that would be left.
RECEIVERS = 16


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row of (doc_id, text).

    ``ids_crc32`` is that of the ids as little-endian 32-bit numbers.
    """

    def run(doc_ids: pa.Array, edges: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        # An end id behind each document.
        lengths = np.diff(edges) + 1
        whole = np.insert(ids, edges[1:], end_id).astype("<u4")
        first = np.cumsum(lengths) - lengths
        n = -(-lengths // capacity)
        place = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(capacity, lengths[place] - start)
        lo = first[place] + start
        crc = [zlib.crc32(whole[a:b].data) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
        columns = [doc_ids.take(pa.array(place)), *(pa.array(c, pa.int64()) for c in (piece, start, length, crc))]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(lo, len(whole)), pa.int32()), pa.array(whole.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    return encoded_texts(docs, path, run, "piece long, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of lengths, each length put, longest first, where it leaves the least room."""
    bins: list[list[int]] = []
    # The bins with exactly that much room, and a bit for each room that some bin has.
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for length in sorted(lengths.tolist(), reverse=True):
        above = rooms >> length
        if above and length <= capacity:
            room = length + (above & -above).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(length)
        else:
            room, at = max(capacity, length), len(bins)
            bins.append([length])
        room -= length
        by_room[room].append(at)
        rooms |= 1 << room
    return bins


class _Exchange:
    """Bins with room, found by the room they would have without nothing, one or two of their lengths."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.fill = [sum(b) for b in bins]
        # room -> bins, for what a single length, and what one or two lengths, may replace.
        self.tables: tuple[list[set[int]], list[set[int]]] = tuple([set() for _ in range(capacity + 1)] for _ in range(2))
        self.bits = [0, 0]
        self.rooms: dict[int, tuple[list[int], list[int]]] = {}
        for at in range(len(bins)):
            self.enter(at)

    def enter(self, at: int) -> None:
        room = self.capacity - self.fill[at]
        if room <= 0 or not self.bins[at]:
            return
        single = np.unique(np.array(self.bins[at]))
        counted = np.bincount(self.bins[at])
        pairs = np.unique(np.add.outer(single, single)[np.triu_indices(len(single), 1)])
        twice = 2 * single[counted[single] > 1]
        own = ([room, *(room + single).tolist()], np.unique(np.concatenate([pairs, twice]) + room).tolist())
        self.rooms[at] = own
        for k in range(2):
            for v in own[k]:
                self.tables[k][v].add(at)
                self.bits[k] |= 1 << v

    def leave(self, at: int) -> None:
        for k, own in enumerate(self.rooms.pop(at, ((), ()))):
            for v in own:
                self.tables[k][v].discard(at)
                if not self.tables[k][v]:
                    self.bits[k] &= ~(1 << v)

    def receiver(self, giver: int, given: int, kinds: tuple[int, ...]) -> tuple[int, int] | None:
        """(bin, length given back) that leaves the receiver the least room, where tokens move to the fuller side."""
        best = None
        for k in kinds:
            bits, base = self.bits[k] >> given, given
            while bits:
                skip = (bits & -bits).bit_length() - 1
                base += skip
                left = base - given
                if best is not None and left >= best[0]:
                    break
                for at in islice(self.tables[k][base], RECEIVERS):
                    room = self.capacity - self.fill[at]
                    moved = room - left
                    if at != giver and moved > 0 and self.fill[at] + moved > self.fill[giver]:
                        best = (left, at, base - room)
                        break
                bits >>= skip + 1
                base += 1
        return best and (best[1], best[2])

    def _taken(self, at: int, total: int) -> list[int]:
        """One or two lengths of a bin that sum to ``total``."""
        own = self.bins[at]
        if not total:
            return []
        if total in own:
            return [total]
        for x in own:
            if total - x in own and (2 * x != total or own.count(x) > 1):
                return [x, total - x]
        raise AssertionError("no such lengths")

    def step(self, giver: int) -> bool:
        """One exchange that takes tokens from ``giver``."""
        own = sorted(set(self.bins[giver]), reverse=True)
        offers = [((x,), (0, 1)) for x in own]
        pairs = {a + b: (a, b) for i, a in enumerate(own) for b in own[i:] if a != b or self.bins[giver].count(a) > 1}
        offers += [(pairs[s], (0,)) for s in sorted(pairs, reverse=True) if s <= self.capacity]
        for given, kinds in offers:
            found = self.receiver(giver, sum(given), kinds)
            if found is None:
                continue
            at, back = found
            returned = self._taken(at, back)
            self.leave(giver)
            self.leave(at)
            for x in given:
                self.bins[giver].remove(x)
                self.bins[at].append(x)
            for x in returned:
                self.bins[at].remove(x)
                self.bins[giver].append(x)
            self.fill[giver] -= sum(given) - back
            self.fill[at] += sum(given) - back
            self.enter(giver)
            self.enter(at)
            return True
        return False


def local_search(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The bins after exchanges that raise the sum of squared fills, without those that ran empty."""
    least = -(-sum(min(sum(b), capacity) for b in bins) // capacity)
    left = EXCHANGES * sum(map(len, bins))
    state, count = None, len(bins)
    while count > least and left > 0:
        state = state or _Exchange(bins, capacity)
        before = left
        for giver in sorted(range(len(bins)), key=lambda b: (state.fill[b], b)):
            if count <= least:
                break
            while bins[giver] and 0 < state.fill[giver] < capacity and left > 0 and state.step(giver):
                left -= 1
            count -= not bins[giver] and not state.fill[giver]
            if bins[giver]:
                continue
            state.fill[giver] = capacity
        if left == before:
            break
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length.  Equal lengths take the places of that length in order."""
    whole = np.maximum(lengths, 0)
    sized = np.flatnonzero(whole)
    bins = local_search(best_fit(whole[sized], capacity), capacity) if len(sized) else [[]]
    bins.sort(key=lambda b: -sum(b))
    places = [(length, number, offset) for number, b in enumerate(bins) for length, offset in zip(b, np.cumsum([0, *b[:-1]]).tolist(), strict=True)]
    places = np.array(sorted(places), np.int64).reshape(-1, 3)
    number, offset = np.full(len(lengths), len(bins) - 1, np.int64), np.zeros(len(lengths), np.int64)
    order = sized[np.argsort(whole[sized], kind="stable")]
    number[order], offset[order] = places[:, 1], places[:, 2]
    return number, offset


def _place(capacity: int, first: int, last: bool):
    """The pieces of a group with their sequences, and whether the next round packs them anew."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_row", "ascending")])
        number, offset = pack_lengths(table["length"].fill_null(0).to_numpy().astype(np.int64), capacity)
        group = table["_group"][0].as_py()
        placed = table.drop_columns(["_row", "_group"]).append_column("sequence_id", pa.array(first + (group << 22) + number))
        return placed.append_column("offset", pa.array(offset)).append_column("_again", pa.array((number == number.max()) & (not last)))

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with a column ``length``) and the sequence and offset each is put at."""
    pieces = pieces.drop("sequence_id", "offset")
    own = T.StructType([*pieces.schema, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")), T.StructField("_again", T.BooleanType())])
    now, done, turn = stored(pieces, "pieces"), [], 0
    while True:
        groups = max(1, -(-now.count() // GROUP))
        row = F.xxhash64("_metadata.file_name", "_metadata.row_index", F.lit(turn))

        dealt = now.select(*pieces.columns, row.alias("_row"), F.pmod(row, F.lit(groups)).alias("_group"))
        packed = stored(dealt.groupBy("_group").applyInArrow(_place(capacity, turn << 58, groups == 1), own), "packed")
        done.append(packed.filter("NOT _again").drop("_again"))
        if groups == 1:
            break
        now, turn = stored(packed.filter("_again").select(*pieces.columns), "pieces"), turn + 1
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces, one behind the other; a sequence is bounded, so each is one small group."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten(F.transform("rows", lambda r: r["ids"])).alias("ids"))
