"""Group-wide and order-dependent values for groups of any size.

One key may hold a third of a table, so no helper here sends a whole group to one task.  Rows are first
reduced per (key, chunk); only the chunk summaries meet per key, and rows join them back on (key, chunk).
A *chunk* is a deterministic column (``seq div n``, a day, a hash): rows of a hot key then spread over many
tasks and a re-run of a lost task gives the same chunks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS = 65536
SPREAD = 64
HOT_KEYS = 1000

_MERGE = {"min": F.min, "max": F.max, "sum": F.sum}


def chunk_of(position: Column | str, size: int = CHUNK_ROWS) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    """Runs of ``size`` sequence numbers.  The numbers count rows; epochs or sparse ids would give a chunk per row."""
    return F.floor(position / F.lit(size))


def spread_of(*cols: str, n: int = SPREAD) -> Column:
    """A deterministic salt from row values, for groups without an order to cut along."""
    return F.pmod(F.xxhash64(*cols), F.lit(n))


def group_values(df: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], spread: Column) -> DataFrame:
    """Attach group-wide ``min`` / ``max`` / ``sum`` values to every row of the group.

    ``spread`` is a deterministic value that differs between the rows of a large group.
    """
    spreaded = df.withColumn("_part", spread)
    on = [*keys, "_part"]
    per_part = spreaded.groupBy(*on).agg(*[_MERGE[k](c).alias(n) for n, (k, c) in values.items()])
    whole = W.partitionBy(*keys)
    merged = per_part.select(*on, *[_MERGE[k](n).over(whole).alias(n) for n, (k, _) in values.items()])
    return spreaded.join(merged, on, "left").drop("_part")


def ordered_values(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | str,
    running: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
) -> DataFrame:
    """Attach running sums (current row included) and the last non-null value of the rows before.

    ``chunk`` must not decrease along ``order``; ``order`` must be unique inside a key.  A chunk given as a column
    name stays in the result, and a following call on it finds the rows already partitioned.
    """
    running, previous = running or {}, previous or {}
    name = chunk if isinstance(chunk, str) else "_chunk"
    chunked = df if isinstance(chunk, str) else df.withColumn("_chunk", chunk)
    chunked = chunked.withColumns({f"_in_{n}": c for n, c in {**running, **previous}.items()})
    on = [*keys, name]
    position = [F.col(o) for o in order]

    def latest(n: str) -> Column:
        value = F.col(f"_in_{n}")
        return F.max(F.when(value.isNotNull(), F.struct(*position, value.alias("_value"))))["_value"]

    summary = chunked.groupBy(*on).agg(
        *[F.sum(f"_in_{n}").alias(n) for n in running], *[latest(n).alias(n) for n in previous]
    )
    earlier = W.partitionBy(*keys).orderBy(name).rowsBetween(W.unboundedPreceding, -1)
    prefix = summary.select(
        *on,
        *[F.sum(n).over(earlier).alias(f"_pre_{n}") for n in running],
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_pre_{n}") for n in previous],
    )
    here = W.partitionBy(*on).orderBy(*order)
    so_far, before = here.rowsBetween(W.unboundedPreceding, 0), here.rowsBetween(W.unboundedPreceding, -1)
    return chunked.join(prefix, on, "left").select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(f"_in_{n}").over(so_far) + F.coalesce(F.col(f"_pre_{n}"), F.lit(0))).alias(n) for n in running],
        *[
            F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(before), F.col(f"_pre_{n}")).alias(n)
            for n in previous
        ],
    )


def first_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows per key.  Spark keeps at most ``n`` rows per key and task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def fits_broadcast(table: DataFrame) -> bool:
    """Whether Spark's own size check lets ``table`` be sent to all tasks."""
    state = table.sparkSession._jsparkSession.sessionState()
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= state.conf().autoBroadcastJoinThreshold()


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table that is unique on ``keys``, without gathering a hot key of ``df`` in one task.

    A table that Spark broadcasts needs no care.  Otherwise keys with more than 1 / ``HOT_KEYS`` of the rows are found by
    a sketch, which every task of ``df`` adds to, and dealt to ``SPREAD`` parts each; their table rows are repeated for
    every part.  The parts are drawn in the order of the rows' hashes, not in the order in which a task meets them: equal
    rows spread too, and a task run again deals the same rows to the same parts.  Rows with a null key, which have no
    partner, spread likewise; all others go straight to the join.
    """
    if fits_broadcast(table):
        return df.join(table, keys, "left")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    digest = F.xxhash64(*keys)
    # One row of the sketch's entries; an entry counted too high only spreads a key that need not be.
    counted = df.filter(known).select(digest.alias("_key")).agg(
        F.count("*").alias("_rows"), F.expr(f"approx_top_k(_key, {HOT_KEYS}, {10 * HOT_KEYS})").alias("_top"))
    hot = F.broadcast(counted.select("_rows", F.explode("_top").alias("_e")).filter(
        F.col("_e.count") * HOT_KEYS > F.col("_rows")).select(F.col("_e.item").alias("_key"), F.lit(True).alias("_hot")))
    # Maps and variants have no hash.
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) if re.search(r"map<|variant", t) else F.col(f"`{c}`") for c, t in df.dtypes]
    drawn = F.col("_hot") | ~known
    part = F.when(drawn, F.floor(F.rand(7) * SPREAD).cast("int")).otherwise(0)
    rows = df.withColumn("_key", digest).join(hot, "_key", "left").sortWithinPartitions(
        F.when(drawn, F.xxhash64(*values))).withColumn("_part", part).drop("_hot", "_key")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    spread = table.withColumn("_key", digest).join(hot, "_key", "left").withColumn("_part", F.explode(parts)).drop("_hot", "_key")
    return rows.join(spread, [*keys, "_part"], "left").drop("_part")
