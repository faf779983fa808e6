"""Approximate nearest neighbours on shifted space-filling curves (operator 3).

1. Equal vectors become one, with the smallest ids kept (as many as are asked for, and one more).
2. Each distinct vector is rotated at random, cut to ``DIMENSIONS`` coordinates, shifted at random and put on a Hilbert
   curve of ``BITS`` bits a coordinate, ``ORDERINGS`` times over.  Spark range-partitions all (ordering, key) rows, so positions on the curves are
   partition offsets plus places inside a partition.
3. Runs of positions are blocks.  A query is compared with its own block and the next ones on both sides in every
   ordering, by the cosine of the components as given; each block keeps its nearest few.  How many
   positions and blocks is measured on the table itself (``reach``): the true neighbours of ``SAMPLE`` queries are
   computed against all rows, and the blocks are made so wide that ``TARGET`` of these lie inside.
4. The merged candidates of a query are reranked by the exact cosine of the original vectors.

A block has at most LARGEST rows however many vectors are alike, so no task grows with a crowded region.  On vectors
without structure the share of the table to be searched hardly falls as it grows, so the work per query grows with the
table; where vectors have structure WINDOW positions are enough.  ``recall`` measures the result against brute force;
figures are in the README.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another dimension than the most frequent one (of equals, the larger); a null id takes no part; of rows that share an id
and a vector one counts.  Nearest first, ties to the smaller id; a query is never its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored

ORDERINGS, DIMENSIONS, BITS, WINDOW = 24, 8, 24, 1024
# Positions a block holds at most; a wider search takes more blocks.
LARGEST = 16384
# Queries whose true neighbours are computed, and the share of these that the blocks compared must hold.
SAMPLE, TARGET = 256, 0.97
# Queries of a block compared at once.
ASKING = 256
# Candidates that a block hands on, and that are reranked, above the number asked for.
SPARE_BLOCK, SPARE_RERANK = 5, 35
SEED = 20240501


def _hilbert_bits(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers (columns of ``bits`` bits), after Skilling.

    The position's bits, highest first, are those of the result's columns taken in turn, from the highest down.
    """
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & q, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    return x


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions as numbers, of at most 63 bits."""
    x = _hilbert_bits(grid, bits)
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, ordering: int) -> np.ndarray:
    """Keys of unit vectors on one randomly rotated and shifted curve, as rows of bytes that sort like the positions."""
    dim = vectors.shape[1]
    rng = np.random.default_rng([SEED, ordering])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :DIMENSIONS]
    # Coordinates lie between -1 and 1, and the shift within the deviation of a random unit vector's coordinate, 1 /
    # sqrt(dim): nothing is clipped, and a cell is 2.4e-7 wide, far below the distances in a crowded region.
    place = (vectors @ rotation + rng.uniform(-1, 1, rotation.shape[1]) / np.sqrt(dim)) / 4 + 0.5
    x = _hilbert_bits((place * ((1 << BITS) - 1)).astype(np.int64), BITS)
    steps = np.arange(BITS - 1, -1, -1)[:, None, None]
    return np.packbits(((x[None, :, :] >> steps) & 1).astype(np.uint8).reshape(-1, x.shape[1]).T, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1)))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v: the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = rows.filter("id IS NOT NULL AND v IS NOT NULL").filter(
        ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0))
    common = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.filter(F.size("v") == (common["d"] if common else 0))


def _on_curves(classes: DataFrame) -> DataFrame:
    """cls, is_query, ordering, key: one row per class and ordering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(2))
            for ordering in range(ORDERINGS):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(unit), ordering, np.int32)),
                     pa.array([r.tobytes() for r in curve_keys(unit, ordering)], pa.binary())], ["cls", "is_query", "ordering", "key"])

    return classes.select("cls", "is_query", "v").mapInArrow(run, "cls long, is_query boolean, ordering int, key binary")


def _packed(classes: DataFrame, kind: str) -> DataFrame:
    """cls and its components as bytes of the numpy type ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in flat.reshape(batch.num_rows, -1)], pa.binary())], ["cls", "packed"])

    return classes.select("cls", "v").mapInArrow(run, "cls long, packed binary")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(size, part, np.int32)), pa.array(np.arange(n, n + size, dtype=np.int64))],
            ["cls", "is_query", "part", "place"])
        n += size


def _block_nearest(k: int, kind: str):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # In a small table a block spans several orderings, and holds a class once for each.
        queries, others = (block[block["asks"] == a].drop_duplicates("cls") for a in (True, False))
        if not len(queries) or not len(others):
            return pd.DataFrame({"query": np.empty(0, np.int64), "cls": np.empty(0, np.int64), "near": np.empty(0)})

        def unit(rows: pd.Series) -> np.ndarray:
            return _unit(np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64))

        asking, there = unit(queries["packed"]), unit(others["packed"]).T
        n, best, nearest_of = min(k, there.shape[1]), [], []
        for at in range(0, len(asking), ASKING):
            near = asking[at : at + ASKING] @ there
            best.append(np.argpartition(-near, n - 1, axis=1)[:, :n])
            nearest_of.append(np.take_along_axis(near, best[-1], axis=1))
        return pd.DataFrame({
            "query": np.repeat(queries["cls"].to_numpy(), n), "cls": others["cls"].to_numpy()[np.concatenate(best)].reshape(-1),
            "near": np.concatenate(nearest_of).reshape(-1)})

    return run


def _true_nearest(members: DataFrame, k: int) -> dict[int, list[int]]:
    """The ``k`` nearest classes of ``SAMPLE`` asking ones, each compared with every class."""
    asked = members.filter("is_query").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("cls", "v").collect()
    if not asked:
        return {}
    own = np.array([r["cls"] for r in asked], np.int64)
    sample = _matrix(pa.array([r["v"] for r in asked], pa.list_(pa.float64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.full((len(own), k), -2.0), np.zeros((len(own), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = batch.column(0).to_numpy()
            near = sample @ _matrix(batch.column(1)).T
            near[own[:, None] == cls[None, :]] = -2
            near = np.concatenate([best, near], axis=1)
            chosen = np.argpartition(-near, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(near, chosen, axis=1)
            at = np.take_along_axis(np.concatenate([at, np.broadcast_to(cls, (len(own), len(cls)))], axis=1), chosen, axis=1)
        fine = best.reshape(-1) > -1.5
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(own, k)[fine]), pa.array(at.reshape(-1)[fine]), pa.array(best.reshape(-1)[fine])], ["query", "cls", "near"])

    order = W.partitionBy("query").orderBy(F.desc("near"), "cls")
    found = members.select("cls", "v").mapInArrow(run, "query long, cls long, near double").withColumn(
        "r", F.row_number().over(order)).filter(F.col("r") <= k)
    near: dict[int, list[int]] = {}
    for r in found.collect():
        near.setdefault(r["query"], []).append(r["cls"])
    return near


def reach(members: DataFrame, placed: DataFrame, total: int, k: int) -> tuple[int, int]:
    """(positions in a block, blocks to either side) that hold ``TARGET`` of the sampled queries' true neighbours.

    ``placed`` has cls and at, the position in all orderings behind each other.
    """
    near = _true_nearest(members, k)
    pairs = [(q, c) for q, found in near.items() for c in found]
    if not pairs:
        return WINDOW, 1
    at: dict[int, list[int]] = {}
    for r in placed.filter(F.col("cls").isin(sorted({x for p in pairs for x in p}))).select("cls", "at").collect():
        at.setdefault(r["cls"], []).append(r["at"])
    here, there = (np.array([at[p[i]] for p in pairs], np.int64) for i in (0, 1))
    width = WINDOW
    while True:
        blocks = -(-width // LARGEST)
        block = -(-width // blocks)
        inside = (np.abs((here // block)[:, :, None] - (there // block)[:, None, :]) <= blocks).any(axis=(1, 2))
        if inside.mean() >= TARGET or width >= total:
            return block, blocks
        width += max(1, width // 4)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, component by component."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` (over ``id``) holds."""
    rows = usable(vectors, vec_id, embedding)
    # Equal vectors: -0.0 and 0.0 are one value.
    rows = rows.select("id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v")).withColumn("asks", is_query)
    ranks = W.partitionBy("v").orderBy("id")
    members = stored(
        rows.dropDuplicates(["id", "v"]).groupBy("v").agg(F.min("id").alias("cls"), F.max("asks").alias("is_query")), "classes")
    # Ids of each class: the smallest k + 1 are enough, as one of them may be the query itself.
    firsts = rows.select("id", "v").dropDuplicates(["id", "v"]).withColumn("r", F.row_number().over(ranks)).filter(
        F.col("r") <= k + 1).join(members.select("v", "cls"), "v").select("cls", F.col("id").alias("member"))
    # Equal keys come in another order on each curve.
    order = ["ordering", "key", F.xxhash64("ordering", "cls"), "cls"]
    placed = _on_curves(members).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(placed.select("cls", "is_query").mapInArrow(
        _numbered, "cls long, is_query boolean, part int, place long"), "curves")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition of the range exchange.
    offsets = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    positions = numbered.join(offsets, "part").withColumn("at", F.col("before") + F.col("place"))
    width, around = reach(members, positions, numbered.count(), k)
    # Components as exact as they are given: a crowded region's vectors differ in their last digits only.
    kind = "<f4" if vectors.schema[embedding].dataType.jsonValue()["elementType"] == "float" else "<f8"
    blocks = positions.withColumn("block", F.floor(F.col("at") / width)).join(_packed(members, kind), "cls")
    asking = blocks.filter("is_query").select(
        "cls", "packed", F.explode(F.sequence(F.col("block") - around, F.col("block") + around)).alias("block"), F.lit(True).alias("asks"))
    both = asking.unionByName(blocks.select("cls", "packed", "block", F.lit(False).alias("asks")))
    found = both.groupBy("block").applyInPandas(
        _block_nearest(k + 1 + SPARE_BLOCK, kind), "query long, cls long, near double")
    merged = found.groupBy("query", "cls").agg(F.max("near").alias("near"))
    order = W.partitionBy("query").orderBy(F.desc("near"), "cls")
    short = merged.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1 + SPARE_RERANK)
    exact = short.select("query", "cls").join(members.select(F.col("cls").alias("query"), F.col("v").alias("qv")), "query").join(
        members.select("cls", "v"), "cls").select("query", "cls", cosine(F.col("qv"), F.col("v")).alias("score"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "cls")
    classes = exact.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r")
    # The k + 1 nearest ids of each asking class serve all its queries.
    order = W.partitionBy("query").orderBy(F.desc("score"), "member")
    answers = classes.join(firsts, "cls").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy(
        "query").agg(F.collect_list(F.struct("r", "member", "score")).alias("answers"))
    queries = rows.filter("asks").select("id", "v").dropDuplicates(["id", "v"]).join(
        members.select("v", F.col("cls").alias("query")), "v").select("id", "query")
    listed = queries.join(answers, "query").select(
        F.col("id").alias("query_id"),
        F.slice(F.filter(F.array_sort("answers"), lambda a: a["member"] != F.col("id")), 1, k).alias("answers"))
    return listed.select("query_id", F.posexplode("answers").alias("pos", "a")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("a.member").alias("vec_id"), F.col("a.score").alias("score"))


def recall(vectors: DataFrame, is_query: Column, k: int = 5) -> float:
    """Share of the true ``k`` nearest that ``nearest`` finds; brute force in blocks, for tests and small tables."""
    rows = usable(vectors).toPandas().drop_duplicates("id")
    m = np.array(rows["v"].tolist())
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = nearest(vectors, is_query, k).groupBy("query_id").agg(F.collect_list("score").alias("s")).toPandas()
    got = dict(zip(found["query_id"], found["s"], strict=True))
    hits = total = 0
    for q in got:
        at = int(np.flatnonzero(rows["id"].to_numpy() == q)[0])
        s = m @ m[at]
        s[at] = -2
        bound = np.sort(s)[-k:][0] if len(s) > k else -1.5
        hits += sum(x >= bound - 1e-9 for x in got[q])
        total += min(k, len(s) - 1)
    return hits / max(1, total)
