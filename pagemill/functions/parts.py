"""Child rows as array columns of bounded length.

A parent with more children than a part holds becomes several rows (``part_no`` 0, 1, ...) whose arrays, read in
order, are the whole list.  Nothing is cut off and no row grows with the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

PART_ROWS = 10000


def in_parts(children: DataFrame, key: str, seq: str, value: Column, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, part_no, name): children per key and run of ``part_rows`` sequence numbers, ordered by ``seq``.

    ``seq`` counts from 0 or 1 and is unique inside a key.
    """
    rows = children.select(key, F.floor(F.col(seq) / part_rows).alias("part_no"), F.struct(
        F.col(seq).alias("seq"), value.alias("value")).alias("_row"))
    grouped = rows.groupBy(key, "part_no").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    return grouped.select(key, "part_no", F.transform("_rows", lambda r: r["value"]).alias(name))


def attach_parts(parents: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Parents with their parts; a parent without children keeps one row with null parts."""
    with_children = ordered.lookup(parts, parents.withColumn("_parent", F.lit(True)), [key]).filter(
        "_parent").drop("_parent")
    childless = parents.join(parts.select(key).distinct(), key, "left_anti")
    return with_children.unionByName(childless, allowMissingColumns=True).withColumn(
        "part_no", F.coalesce("part_no", F.lit(0)))
