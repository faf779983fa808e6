"""Learned routes under a cap that holds at every event.

After each event at most ``cap`` routes are kept, the least recently used one goes first.  Whether a failure refreshes a
route depends on whether the cap had already pushed it out, so events act on each other across keys and no count per key
settles the matter.  What does not grow is the state between two events: ``cap`` entries.

1. Events are sorted into slices of about ``slice_events`` by time, each written by one task.
2. Every slice is folded one event after the other, all slices at once, each from the entries the slice before it ended
   with in the round before (from none in the first round).
3. Slices whose first entries have changed are folded again, until none has.  Then each slice began where the one before
   it ended, so the result is that of one pass over all events.  Entries forget: after ``cap`` other routes have been
   used, or the TTL, nothing is left of what a slice began with, so a few rounds suffice where slices are longer than
   that; the first round alone where the log fits one slice.
4. Wins would be remembered for ever.  A slice therefore only tells how many it added and whether it went on counting;
   they are added up over the slices at the end.

No task holds more than a slice and ``cap`` entries; a hot key spreads over slices like all others.
"""

from __future__ import annotations

import datetime
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.lineage import new_folder
from ..functions.workers import ship

SLICE_EVENTS = 1 << 18
_ENTRY = "slice int, pos int, key string, route string, fails int, used long, success long, inherits boolean, wins long"


def _fold_slice(ttl: int, cap: int, order: list[str]):
    """The entries a slice ends with, in order of use; ``inherits`` where wins go on from those it began with."""

    def run(events: pa.Table, entries: pa.Table) -> pa.Table:
        store: OrderedDict[str, list] = OrderedDict()
        for e in sorted(entries.to_pylist(), key=lambda e: e["pos"]):
            store[e["key"]] = [e["route"], e["fails"], e["used"], e["success"], True, 0]
        events = events.sort_by([(c, "ascending") for c in order])
        for key, at, ok, strike, route in zip(*(events[c].to_pylist() for c in ("key", "at", "ok", "strike", "route")), strict=True):
            while store and at - next(iter(store.values()))[2] > ttl:
                store.popitem(last=False)
            entry = store.get(key)
            if ok:
                goes_on = entry is not None and entry[0] == route
                store[key] = [route, 0, at, at, goes_on and entry[4], entry[5] + 1 if goes_on else 1]
                store.move_to_end(key)
                if len(store) > cap:
                    store.popitem(last=False)
            elif entry is not None:
                entry[1], entry[2] = entry[1] + strike, at
                if entry[1] >= rules.EVICT_AFTER:
                    del store[key]
                else:
                    store.move_to_end(key)
        number = (events if events.num_rows else entries)["slice"][0].as_py()
        rows = [(number, pos, key, *entry) for pos, (key, entry) in enumerate(store.items())]
        schema = pa.schema([("slice", pa.int32()), ("pos", pa.int32()), ("key", pa.string()), ("route", pa.string()), ("fails", pa.int32()),
                            ("used", pa.int64()), ("success", pa.int64()), ("inherits", pa.bool_()), ("wins", pa.int64())])
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    return run


def fold_routes_lru(outcomes: DataFrame, as_of: datetime.datetime | Column, ttl_days: float = rules.ROUTE_TTL_DAYS, cap: int = 500,
                    order: list[str] | None = None, initial: DataFrame | None = None, slice_events: int = SLICE_EVENTS) -> DataFrame:
    """C5 with the cap applied at every event: key, route, wins, consecutive_fails, last_used, last_success.

    As :func:`.fetchlog.fold_routes`, but of more than ``cap`` live routes the least recently used goes at once, and a
    failure after that is one of a route not known.  ``ts`` and ``key`` must not be null; events of equal time follow the
    ``order`` columns, then a hash of the row, and a later one counts as the more recent use.  ``initial`` holds at most
    ``cap`` entries of an earlier fold.
    """
    spark = outcomes.sparkSession
    ship(spark)
    kind = outcomes.schema["route"].dataType
    route = F.col("route") if isinstance(kind, T.StringType) else F.to_json(F.struct(F.col("route").alias("v")))
    strike = (~F.col("ok") & F.coalesce(F.col("stop_reason"), F.lit("")).isin(rules.PENALIZED_REASONS)).cast("int")
    ties = [c for c in order or [] if c != "ts"]
    events = outcomes.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ok", strike.alias("strike"), route.alias("route"), *ties)
    events = events.withColumn("_tie", F.xxhash64(*events.columns))
    sequence = ["at", *ties, "_tie"]
    folder = new_folder(spark, "slices")
    slices = max(1, -(-outcomes.count() // slice_events))
    events.repartitionByRange(slices, *sequence).withColumn("slice", F.spark_partition_id()).write.partitionBy("slice").parquet(f"{folder}/events")
    rows = spark.read.schema(T.StructType([*events.schema, T.StructField("slice", T.IntegerType())])).parquet(f"{folder}/events")
    none = spark.createDataFrame([], _ENTRY)
    first = none
    if initial is not None:
        plain = initial if isinstance(kind, T.StringType) else initial.withColumn("route", F.to_json(F.struct(F.col("route").alias("v"))))
        known = plain.select("key", "route", F.col("consecutive_fails").alias("fails"), F.unix_micros("last_used").alias("used"),
                             F.unix_micros("last_success").alias("success"), F.col("wins").cast("long").alias("wins"))
        at = F.struct("used", "key")
        order_of = known.agg(F.array_sort(F.collect_list(at)).alias("all"))  # At most ``cap`` entries.
        first = known.join(F.broadcast(order_of)).select(
            F.lit(-1).alias("slice"), (F.array_position("all", at) - 1).cast("int").alias("pos"), "key", "route",
            F.col("fails").cast("int").alias("fails"), "used", "success", F.lit(False).alias("inherits"), "wins")

    fold = _fold_slice(int(ttl_days * 86400 * 1_000_000), cap, sequence)

    def folded(some: DataFrame, starts: DataFrame) -> DataFrame:
        return some.groupBy("slice").cogroup(starts.groupBy("slice")).applyInArrow(fold, _ENTRY)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def starts_after(ends: DataFrame) -> DataFrame:
        """What each slice begins with: the entries of the one before, those given in the first."""
        return first.unionByName(ends).withColumn("slice", F.col("slice") + 1).filter(F.col("slice") < slices)

    def digests(starts: DataFrame) -> DataFrame:
        entry = ("pos", "key", "route", "fails", "used", "success")
        return starts.groupBy("slice").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*entry)).alias("x"),
                                           F.sum(F.xxhash64(F.lit(7), *entry).cast("decimal(20,0)")).alias("s"))

    starts = kept(starts_after(none), "starts-0")
    ends, turn = kept(folded(rows, starts), "ends-0"), 0
    # After as many rounds as there are slices every slice has had its true beginning.
    while True:
        turn += 1
        fresh = kept(starts_after(ends), f"starts-{turn}")
        before, now = digests(starts), digests(fresh)
        changed = kept(now.join(before, ["slice", "n", "x", "s"], "left_anti").select("slice").unionByName(
            before.join(now, "slice", "left_anti").select("slice")), f"changed-{turn}")
        if changed.isEmpty():
            break
        again = folded(rows.join(changed, "slice", "left_semi"), fresh.join(changed, "slice", "left_semi"))
        ends = kept(ends.join(changed, "slice", "left_anti").unionByName(again), f"ends-{turn}")
        starts = fresh
    history = first.unionByName(ends)
    last = ends.filter(F.col("slice") == slices - 1).drop("slice", "pos", "inherits", "wins")
    # Counting began in the newest slice that did not go on from the one before.
    counted = history.join(last.select("key"), "key", "left_semi")
    begun = counted.filter(~F.col("inherits")).groupBy("key").agg(F.max("slice").alias("from"))
    wins = counted.join(begun, "key").filter(F.col("slice") >= F.col("from")).groupBy("key").agg(F.sum("wins").alias("wins"))
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    fresh = F.unix_micros(now.cast("timestamp")) - F.col("used") <= int(ttl_days * 86400 * 1_000_000)
    entries = last.join(wins, "key").filter(fresh).select(
        "key", "route", "wins", F.col("fails").alias("consecutive_fails"), F.timestamp_micros("used").alias("last_used"),
        F.timestamp_micros("success").alias("last_success"))
    if isinstance(kind, T.StringType):
        return entries
    return entries.withColumn("route", F.from_json("route", T.StructType([T.StructField("v", kind)]))["v"])
