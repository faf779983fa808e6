"""Byte-pair encoding and decoding over a table of distinct words (operator 10).

A word here is a run of characters without white space.  The tokenizer's own pre-tokenizer never joins across white
space, its normal form composes nothing across it, and its special tokens hold none, so the ids of a text are the ids
of its words in turn; ``tests/llm`` checks that against the tokenizers library on random text.

1. Texts are split where they lie.  Each run of rows (a *batch*) becomes one row: every text as the numbers of its
   words, compressed, and the batch's distinct words, once each, dealt into ``BUCKETS`` lists by a hash.  Capitals A-Z
   are lowered first, as the tokenizer does itself, unless the text may hold a special token.
2. The lists meet by bucket, so all batches' copies of a word meet in one task, which encodes each distinct word once.
3. The ids go back to the batches by (batch, bucket), word numbers are replaced by them in order of position, and the
   ids are joined to the vocabulary for their pieces.

Word lists repeat between batches but not between texts, and numbers compress to under half of the text, so far less
than the texts is shuffled; no word, however frequent, has more entries than there are batches.  A batch holds
about ``BATCH_CHARS`` bytes or one longer text, a bucket 1 / ``BUCKETS`` of all distinct words.

Decoding joins ids to pieces and puts a space between pieces, as the library does for a tokenizer without decoder.

Defined results: a null text is empty; an empty or blank text has no ids and decodes to the empty string; rows keep
their number, so equal rows and null ids come back as often as they came in.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import bucketed
from .words import _bytes_of

# Bytes of text after which a batch is closed.
BATCH_CHARS = 8_000_000
BUCKETS = 256
# Bytes of words of a bucket, or one list, that are encoded at a time.
LIST_BYTES = 4_000_000
# Python's split also parts at 0x1c-0x1f, which the tokenizer does not take for white space.
_NOT_SPACE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# The marks that compose with A-Z or a-z.
_MARK = re.compile("[\u0300-\u036f]")
_EXTRA = re.compile("[\x1c-\x1f]")
# White space of one byte in UTF-8, and the first byte of longer ones.
_WHITE_BYTE, _WHITE_LEAD = (np.isin(np.arange(256), own) for own in ([*range(0x09, 0x0E), 0x20], [0xC2, 0xE1, 0xE2, 0xE3]))
# Signs the pre-tokenizer parts from a letter before them, and that compose with none.  Apostrophes may begin an ending.
_SIGNS = "!\"#$%&()*+,-./:;?@[]_"


def split_words(text: str) -> list[str]:
    """The runs without white space."""
    return _NOT_SPACE.findall(text) if _EXTRA.search(text) else text.split()


def lowered(text: str) -> str:
    """A-Z lowered where that changes no id.

    Special tokens are told by case, and the tokenizer composes marks before it lowers letters, so texts with either
    are left alone.
    """
    if "<|" in text or not text.isascii() and _MARK.search(text):
        return text
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def parted(word: str) -> tuple[str, str]:
    """A word and the signs behind it, which the tokenizer encodes each for itself where a letter stands before them."""
    stem = word.rstrip(_SIGNS)
    if len(stem) == len(word) or not stem or not stem[-1].isalpha() or "<|" in word:
        return word, ""
    return stem, word[len(stem) :]


@lru_cache(maxsize=1)
def _packers() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for all calls of a worker: to make one costs as much as to pack a short list."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte planes apart, which compress better."""
    return _packers()[0].compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_packers()[1].decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _lowered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """:func:`lowered` for texts as bytes, one behind the other from the offsets ``at`` on."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    pairs = data[:-1], data[1:]
    kept = (pairs[0] == 0x3C) & (pairs[1] == 0x7C) | (pairs[0] == 0xCC) | (pairs[0] == 0xCD) & (pairs[1] < 0xB0)
    for row in np.unique(np.searchsorted(at, np.flatnonzero(kept), "right") - 1).tolist():
        low[at[row] : at[row + 1]] = data[at[row] : at[row + 1]]
    return low


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space, as :func:`split_words` has it."""
    white = _WHITE_BYTE[data]
    at = np.flatnonzero(_WHITE_LEAD[data])
    if len(at):
        padded = np.append(data, np.zeros(2, np.uint8))
        one, two, three = (padded[at + k] for k in range(3))
        short = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
        long = (one == 0xE1) & (two == 0x9A) & (three == 0x80)
        long |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
        long |= (one == 0xE2) & (two == 0x81) & (three == 0x9F) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
        for k in range(3):
            white[at[long | short if k < 2 else long] + k] = True
    return white


def _runs(data: np.ndarray, letter: np.ndarray, first: np.ndarray) -> pa.Array:
    """The runs of bytes marked in ``letter``, each from a byte marked in ``first`` on."""
    own = data[letter]
    offsets = np.append(np.flatnonzero(first[letter]), len(own))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(own)])


def number_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, the number of each word, and the distinct words by number, A-Z lowered.

    ``data`` are the texts' bytes, one behind the other from the offsets ``at`` on.
    """
    data = _lowered(data, at)
    letter = ~_white(data)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    # A text's first byte begins a word even behind another text's letter.
    begin = at[:-1][at[:-1] < len(data)]
    first[begin] = letter[begin]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), at))
    found = _runs(data, letter, first).dictionary_encode()
    return counts, found.indices.to_numpy(), found.dictionary


def split_batches(docs: DataFrame, id_type: str) -> DataFrame:
    """batch, ids, lengths, numbers, homes, lists: one row per batch.

    ``numbers`` are all texts' words one behind the other, ``homes`` the bucket of each distinct word by number, and
    ``lists`` the words of each bucket in order of number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, signs = TaskContext.get().partitionId(), 0, _SIGNS.encode()

        def close() -> pa.RecordBatch:
            keys = pa.concat_arrays([k for k, _, _ in held])
            ends = np.cumsum(np.concatenate([[0], *(n for _, _, n in held)]))
            lengths, numbers, found = number_words(np.concatenate([d for _, d, _ in held]), ends)
            words = found.to_numpy(zero_copy_only=False).tolist()
            # Words that differ in the signs behind them only meet in one bucket.
            homes = [zlib.crc32(w.rstrip(signs)) % BUCKETS for w in words]
            lists: list[list[bytes]] = [[] for _ in range(BUCKETS)]
            for word, home in zip(words, homes, strict=True):
                lists[home].append(word)
            packed = [_packers()[0].compress(b" ".join(own)) if own else None for own in lists]
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) | made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths, pa.int32())),
                pa.array([_pack(numbers)], pa.binary()), pa.array([_pack(np.array(homes, dtype=np.int64))], pa.binary()),
                pa.array([packed], pa.list_(pa.binary()))], ["batch", "ids", "lengths", "numbers", "homes", "lists"])

        held, size = [], 0
        for batch in batches:
            data, at = _bytes_of(batch.column(1))
            # Each text counts for one more than its bytes, so empty ones fill a batch too.
            cost, row = at + np.arange(len(at)), 0
            while row < batch.num_rows:
                last = min(batch.num_rows, int(np.searchsorted(cost, cost[row] + BATCH_CHARS - size)))
                # Copies, so that no more than a batch of what is read is held.
                held.append((pa.concat_arrays([batch.column(0).slice(row, last - row)]), data[at[row] : at[last]].copy(), np.diff(at[row : last + 1])))
                size += int(cost[last] - cost[row])
                row = last
                if size >= BATCH_CHARS:
                    yield close()
                    made += 1
                    held, size = [], 0
        if held:
            yield close()

    return docs.mapInArrow(
        run, f"batch long, ids array<{id_type}>, lengths array<int>, numbers binary, homes binary, lists array<binary>")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_lists(lists: DataFrame, path: str) -> DataFrame:
    """batch, bucket, counts, flat for (batch, bucket, list): how many ids each word of the list has, and the ids.

    All lists of a bucket meet in one task, where each distinct word is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        bucket, known = None, {}

        def encoded(numbers: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            data = np.frombuffer(b" ".join(texts), np.uint8)
            letter = data != 32
            first = np.append(True, ~letter[:-1])
            found = _runs(data, letter, first).dictionary_encode()
            words = [w.decode("utf-8", "surrogatepass") for w in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
            parts = [parted(w) for w in words if w not in known]
            new = list({p for pair in parts for p in pair if p not in known})
            if new:
                known.update(zip(new, (e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            known.update((a + b, known[a] + known[b]) for a, b in parts)
            own = [known[w] for w in words]
            counts = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.fromiter(chain.from_iterable(own), np.int64, int(counts.sum()))
            place = found.indices.to_numpy()
            ids, stops = _gathered(counts, np.cumsum(counts) - counts, flat, place)
            # The words of each list.
            edges = np.cumsum([0, *(t.count(b" ") + 1 for t in texts)]).tolist()
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            return pa.RecordBatch.from_arrays([
                numbers, pa.array([bucket] * len(texts), pa.int32()), pa.array([_pack(counts[place[a:b]]) for a, b in spans], pa.binary()),
                pa.array([_pack(ids[stops[a] : stops[b]]) for a, b in spans], pa.binary())], ["batch", "bucket", "counts", "flat"])

        for batch in batches:
            numbers, homes, packed = batch.columns
            start, texts, size = 0, [], 0
            for r, home in enumerate(homes.to_pylist()):
                if texts and (home != bucket or size >= LIST_BYTES):
                    yield encoded(numbers.slice(start, r - start), texts)
                    start, texts, size = r, [], 0
                if home != bucket:
                    bucket, known = home, {}
                texts.append(_packers()[1].decompress(packed[r].as_py()))
                size += len(texts[-1])
            if texts:
                yield encoded(numbers.slice(start), texts)

    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.select("batch", "bucket", "list").repartition(n, "bucket").sortWithinPartitions("bucket", "batch")
    return dealt.mapInArrow(run, "batch long, bucket int, counts binary, flat binary")


def pieces_of(path: str) -> dict[int, str]:
    """id -> piece of the tokenizer file, special tokens included."""
    with open(path, encoding="utf-8") as f:
        tokenizer = json.load(f)
    pieces = {number: piece for piece, number in tokenizer["model"]["vocab"].items()}
    return pieces | {t["id"]: t["content"] for t in tokenizer["added_tokens"]}


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: one row per entry of the tokenizer file."""
    pieces = pieces_of(path)
    return spark.createDataFrame(pd.DataFrame({"id": list(pieces), "piece": list(pieces.values())}), "id int, piece string")


def decode(encoded: DataFrame, pieces: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """key, decoded: the pieces of each row's ids with a space between; ``key`` is unique.

    An id that the vocabulary has not is passed over, as the library does.
    """
    rows = encoded.select(key, F.posexplode(ids).alias("pos", "id")).join(pieces, "id")
    texts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("rows"))
    joined = texts.select(key, F.array_join(F.transform("rows", lambda r: r["piece"]), " ").alias("decoded"))
    return encoded.select(key).join(joined, key, "left").select(key, F.coalesce("decoded", F.lit("")).alias("decoded"))


def _gathered(counts: np.ndarray, starts: np.ndarray, flat: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words one behind the other, and where those of each word begin; word w has counts[w] from starts[w] on in flat."""
    n = counts[words]
    stops = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(starts[words] - stops[:-1], n) + np.arange(int(stops[-1]))], stops


def ids_of_batch(batch: pa.Table, coded: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, edges and ids of a batch's texts: about 250,000 words at a time, or one longer text.

    ``batch`` is one row of :func:`split_batches`, ``coded`` the rows of :func:`encode_lists` for it.
    """
    doc_ids, lengths, numbers, homes = (batch[c][0] for c in ("ids", "lengths", "numbers", "homes"))
    numbers, order = _unpack(numbers.as_py()), np.argsort(_unpack(homes.as_py()), kind="stable")
    coded = coded.sort_by("bucket")
    n, flat = (np.concatenate([np.empty(0, np.int64), *map(_unpack, coded[c].to_pylist())]) for c in ("counts", "flat"))
    # The lists, bucket by bucket, hold the words in this order of their numbers.
    counts, starts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    counts[order], starts[order] = n, np.cumsum(n) - n
    doc_values, ends = doc_ids.values, np.cumsum(lengths.values.to_numpy())
    done = 0
    while done < len(ends):
        first = ends[done - 1] if done else 0
        last = max(done + 1, int(np.searchsorted(ends, first + (1 << 18), "right")))
        ids, stops = _gathered(counts, starts, flat, numbers[first : ends[last - 1]])
        yield doc_values.slice(done, last - done), stops[np.concatenate([[0], ends[done:last] - first])], ids
        done = last


def encoded_texts(docs: DataFrame, path: str, compose: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``compose`` makes of doc_ids, edges and ids of texts, some at a time, for every row of (doc_id, text).

    ``schema`` are its columns, of which doc_id, a long or a string, is the first and left out.  Each batch meets its ids
    alone, so a task never holds, here or in Spark, more than one of its batches.
    """
    id_type = "string" if isinstance(docs.schema["doc_id"].dataType, T.StringType) else "bigint"
    # The numbers are by far the largest part: bucketed, they stay where they are when the ids come back.
    batches = bucketed(split_batches(docs.select(F.col("doc_id").cast(id_type), F.col("text").cast("string")), id_type), "batches", "batch")
    lists = batches.select("batch", F.posexplode("lists").alias("bucket", "list")).filter("list IS NOT NULL")
    whole = batches.select("batch", "ids", "lengths", "numbers", "homes").groupBy("batch")

    def run(batch: pa.Table, coded: pa.Table) -> pa.Table:
        return pa.Table.from_batches([compose(*texts) for texts in ids_of_batch(batch, coded)])

    return whole.cogroup(encode_lists(lists, path).groupBy("batch")).applyInArrow(run, f"doc_id {id_type}, {schema}")


def _composed(pieces):
    """Ids and decoded texts.

    ``pieces`` is the broadcast vocabulary, as large as the tokenizer file: the side the ids are joined to.
    """
    spelled = None

    def run(doc_ids: pa.Array, edges: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        nonlocal spelled
        if spelled is None:
            spelled = np.full(max(pieces.value, default=0) + 1, None, dtype=object)
            for number, piece in pieces.value.items():
                spelled[number] = piece
        texts = spelled[ids].tolist()
        decoded = [" ".join([x for x in texts[a:b] if x is not None]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([
            doc_ids, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
            ["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded for every row of ``docs`` (doc_id, text), with the tokenizer file at ``path``."""
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_of(path))
    return encoded_texts(docs, path, _composed(pieces), "ids array<int>, decoded string")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows, and the ids if wanted."""
    return encoded.select(
        "doc_id", *(["ids"] if keep_ids else []), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
