"""Near-duplicate groups by min-max hashing (operator 7).

Every text becomes the set of its ``shingle_words``-word shingles (see :mod:`.words`).  Under each permutation both the
smallest and the largest value are kept, so half the hash evaluations fill a signature.  Bands of the signature put
similar texts into common buckets; links are confirmed on the full sets.

No bucket is expanded into pairs.  Equal sets are one node from the start.  In each bucket the node found in the most
rows of all buckets is the pivot, and all nodes that meet one pivot anywhere form its group:

1. every node of a group is compared with the pivot, and confirmed links join nodes to components;
2. where a group still holds several components, the nodes outside the pivot's component are compared with the whole
   group, in blocks of bounded size.  Two nodes of one component need no comparison.

So every pair with a common bucket is either confirmed, refuted or already connected.  A pair at the threshold shares
no bucket with a probability of (1 - s^rows)^bands, 1e-5 at 0.85 and 1e-3 at 0.8 for 6 rows and 24 bands.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a null ``doc_id`` takes no
part and comes back with a null component and ``kept``; equal rows are one group; rows that share a ``doc_id`` but not
a set are only linked by their texts.

The driver holds no table that grows with the input.  Texts meet lists of ids as sorted arrays, and tables whose rows are
multiplied before a join are merged: Spark knows their size only from before, and would broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .stored import remove, stored, write

ROWS, BANDS = 6, 24
# Shingles in a block of sets that is compared in one task.
BLOCK_SHINGLES = 1 << 18
# Tasks that the nodes of one pivot are dealt to in joins on it.
SALTS = 32
# Candidate ids up to this number are sent to all executors, 8 bytes each; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
_SALT = np.uint64(0x5851F42D4C957F2D)


def signatures(docs: DataFrame, shingle_words: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (a 128-bit digest of the set) and the band keys of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                            ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            ids = batch.column(0)
            for row, hashes, offsets in words.word_hashes(batch.column(1)):
                sets, sizes = words.distinct_sets(*words.shingles(hashes, offsets, shingle_words))
                n, full = len(sizes), np.flatnonzero(sizes)
                digest = np.zeros((2, n), dtype=np.uint64)
                keys = np.empty((0, bands), dtype=np.int64)
                if len(full):
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    digest[0, full] = np.add.reduceat(sets, starts)
                    digest[1, full] = np.add.reduceat(words.mix(sets ^ _SALT), starts)
                    signature = words.min_max_signature(sets, sizes[full], rows * bands // 2).astype(np.uint64)
                    keys = np.stack([band_key(signature[:, b * rows : (b + 1) * rows], b) for b in range(bands)], axis=1)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)),
                    pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), pa.array(sizes), *(pa.array(d.view(np.int64)) for d in digest), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def band_key(part: np.ndarray, band: int) -> np.ndarray:
    """One 64-bit key of the signature values of a band."""
    key = np.full(len(part), band + 1, dtype=np.uint64)
    for column in part.T:
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """node, n, values: the full sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, hashes, offsets in words.word_hashes(batch.column(1)):
                sets, sizes = words.distinct_sets(*words.shingles(hashes, offsets, shingle_words))
                ends = np.cumsum(sizes)
                values = [sets[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sizes)), pa.array(sizes), pa.array(values, pa.binary())], ["node", "n", "set"])

    return docs.mapInArrow(run, "node long, n long, set binary")


def _compare(percent: int):
    """Links between the two sides of a block: each node of side 0 with its first partner of each other component."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            values = [np.frombuffer(v, dtype=np.uint64) for v in right["set"]]
            sizes = np.array([len(v) for v in values])
            starts = np.cumsum(sizes) - sizes
            universe, columns = np.unique(np.concatenate(values), return_inverse=True)
            nodes, labels = right["node"].to_numpy(), right["label"].to_numpy()
            mark = np.zeros(len(universe), dtype=np.int64)
            for node, label, own in zip(left["node"], left["label"], left["set"], strict=True):
                own = np.frombuffer(own, dtype=np.uint64)
                at = np.searchsorted(universe, own)
                at[at == len(universe)] = 0
                at = at[universe[at] == own]
                mark[at] = 1
                shared = np.add.reduceat(mark[columns], starts)
                mark[at] = 0
                linked = (100 * shared >= percent * (len(own) + sizes - shared)) & (labels != label)
                if linked.any():
                    _, first = np.unique(labels[linked], return_index=True)
                    found.extend((node, other) for other in nodes[linked][first])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _among(ids: DataFrame) -> Column:
    """Whether doc_id is one of ``ids`` (long, no nulls), which go to all tasks as one sorted array.

    A broadcast join would cost the driver over a hundred bytes an id.
    """
    known = ids.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))

    @F.arrow_udf("boolean")
    def found(doc_id: pa.Array) -> pa.Array:
        own = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(known.value):
            return pa.array(np.zeros(len(own), dtype=bool))
        at = np.minimum(np.searchsorted(known.value, own), len(known.value) - 1)
        return pa.array((known.value[at] == own) & doc_id.is_valid().to_numpy(zero_copy_only=False))

    whole = F.col("doc_id").cast("long")
    return found(whole) & F.coalesce(whole == F.col("doc_id"), F.lit(False))


def _with_pivot(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table of one row per pivot to its nodes; the nodes of a large group go to several tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(spread.hint("merge"), ["pivot", "salt"]).drop("salt")


def _links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b).  ``groups``: pivot, node, label, left (whether the node is compared with all others)."""
    sized = groups.join(sets.select("node", "n"), "node")
    per = sized.groupBy("pivot").agg(
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("n_right"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("left"), F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int").alias("n_left"))
    placed = _with_pivot(sized, per).select(
        "pivot", "node", "label", "left", "n_left", "n_right",
        F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_left")).cast("int").alias("i"),
        F.pmod(F.xxhash64("node", F.lit(2)), F.col("n_right")).cast("int").alias("j"))
    lefts = placed.filter("left").select("pivot", "node", "label", F.lit(0).alias("side"), "i", F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"))
    rights = placed.select("pivot", "node", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), "j")
    blocks = lefts.unionByName(rights).join(sets.select("node", "set").hint("merge"), "node")
    return blocks.groupBy("pivot", "i", "j").applyInPandas(_compare(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over ``edges`` (a, b), for every node with an edge.

    Large-star and small-star steps by turns, each a grouped minimum and a join, until no edge changes; every round is
    written to the shared folder and the one before is deleted.
    """
    spark = edges.sparkSession
    path = write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = spark.read.schema("a long, b long").parquet(path)
        seen = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if seen == state or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                now.select("b", "b")).groupBy("node").agg(F.min("label").alias("label"))
        state = seen
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(
            below.select("a", F.col("m").alias("b"))).distinct()
        following = write(small, "edges")
        remove(spark, path)
        path = following


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) for every row of ``docs``.

    Two texts are linked when 100 * |A and B| >= percent * |A or B| for their shingle sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(docs, shingle_words, rows, bands), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["d1", "d2", "n_shingles"]
    nodes = usable.groupBy(*digest).agg(F.min("doc_id").alias("node"))
    firsts = usable.select("doc_id", *digest, "bands").join(
        nodes.withColumnRenamed("node", "doc_id"), ["doc_id", *digest], "left_semi").dropDuplicates(["doc_id", *digest])
    entries = firsts.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = stored(entries.join(shared.hint("merge"), "key"), "members")
    popular = members.groupBy("node").agg(F.sum("c").alias("pop"))
    ranked = members.select("key", "node").join(popular, "node")
    pivots = ranked.groupBy("key").agg(F.max("pop").alias("pop")).join(ranked, ["key", "pop"]).groupBy("key").agg(
        F.min("node").alias("pivot"))
    groups = stored(members.select("key", "node").join(pivots, "key").select("pivot", "node").distinct(), "groups")
    wanted = groups.select(F.col("node").alias("doc_id")).distinct()
    few = wanted.count() <= broadcast_ids
    texts = docs.filter(_among(wanted)) if few else docs.join(wanted.hint("merge"), "doc_id", "left_semi")
    # A doc_id may stand at several texts: the text of the node is the one with its digest.
    sets = stored(_sets(texts, shingle_words).dropDuplicates(["node", "set"]), "sets")
    first = groups.select("pivot", "node", F.col("node").alias("label"), (F.col("node") == F.col("pivot")).alias("left"))
    links = stored(_links(first, sets, percent), "links")
    labels = components(links)
    labelled = groups.join(labels, "node", "left").select("pivot", "node", F.coalesce("label", "node").alias("label"))
    own = labelled.filter("pivot = node").select("pivot", F.col("label").alias("own"))
    compared = _with_pivot(labelled, own).select("pivot", "node", "label", (F.col("label") != F.col("own")).alias("left"))
    # A group whose other nodes were only compared with its pivot may still hold links among those.
    open_groups = compared.filter("left").groupBy("pivot").agg(F.count("*").alias("others")).filter("others > 0")
    second = stored(_with_pivot(compared, open_groups.select("pivot")), "open")
    more = stored(_links(second, sets, percent), "links")
    final = components(links.union(more))
    component = nodes.join(final, "node", "left").select(*digest, F.coalesce("label", "node").alias("component_id"))
    hot = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    spread = component.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    found = usable.select("doc_id", *digest).withColumn("salt", hot).join(spread.hint("merge"), [*digest, "salt"]).select(
        "doc_id", "n_shingles", "component_id")
    rest = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` without near copies of a document with a smaller id, all columns as they were.

    Of equal rows (doc_id and text) one stays.  Of texts that share a doc_id those of distinct texts stay, if any of
    them is kept.  Rows without a doc_id stay.  Texts are not shuffled while at most ``broadcast_ids`` ids go.
    """
    found = stored(near_duplicates(docs, shingle_words, percent, broadcast_ids=broadcast_ids).select("doc_id", "kept"), "kept")
    per_id = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone, repeated = per_id.filter("NOT kept").select("doc_id"), per_id.filter("kept AND n > 1").select("doc_id")

    def parts(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows whose doc_id is one of ``ids``, and the others."""
        if ids.count() <= broadcast_ids:
            known = _among(ids)
            return rows.filter(known), rows.filter(~known)
        with_ids, without = (rows.join(ids.hint("merge"), "doc_id", how) for how in ("left_semi", "left_anti"))
        return with_ids.select(*docs.columns), without.select(*docs.columns)

    rest = parts(docs, gone)[1]
    if repeated.isEmpty():
        return rest
    several, single = parts(rest, repeated)
    return single.union(several.dropDuplicates(["doc_id", "text"]))
