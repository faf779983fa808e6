"""Streaming forms of the keyed folds (C6, C7), on Spark's own keyed state.

A micro-batch reads and writes the state of the keys it holds and of no others; Spark's state store keeps the versions,
restores them after a failure and drops old ones.  Results go to a file sink, which takes each batch once.  A key's rows
of one micro-batch meet in one task, so the source's limit on a micro-batch (``maxFilesPerTrigger`` and the like) bounds
what a hot key brings at once; what is kept of them is a few numbers a row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import rules
from ..functions.workers import setting, ship
from ..operators.enrich import classify_errors

# Timers and lists in state need this state store.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "alive boolean, route string, wins long, fails int, used long, success long, seen long, timer long"
_CHANGE = "key string, change string, route string, wins long, consecutive_fails int, used long, success long"


class RouteFold(StatefulProcessor):
    """One entry per key; an entry that was evicted stays as a tombstone until no earlier outcome can come.

    ``seen`` is the time of the last outcome of a key: an older one is late.  The timer stands where the entry's age
    ends, or for a tombstone where the watermark passes it.
    """

    def __init__(self, ttl_micros: int, order: list[str]):
        self.ttl, self.order = ttl_micros, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _ENTRY)

    def _keep(self, old_timer: int | None, alive: bool, route: str | None, wins: int, fails: int, used: int, success: int, seen: int) -> None:
        timer = (used + self.ttl if alive else seen) // 1000 + 1
        if timer != old_timer:
            if old_timer is not None:
                self.handle.deleteTimer(old_timer)
            self.handle.registerTimer(timer)
        self.entry.update((alive, route, wins, fails, used, success, seen, timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Nulls of the ties come last.
        events = sorted(rows, key=lambda e: (e["at"], *((e[c] is None, e[c]) for c in self.order)))
        alive, route, wins, fails, used, success, seen, timer = self.entry.get() or (False, None, 0, 0, 0, 0, None, None)
        for event in events:
            at, ok, strike, new = event["at"], event["ok"], event["strike"] or 0, event["route"]
            if seen is not None and at < seen:
                yield _change(key[0], "late", new, 1 if ok else 0, strike, at, at if ok else None)
                continue
            seen = at
            if alive and at - used > self.ttl:
                alive = False
            if ok:
                wins = wins + 1 if alive and route == new else 1
                alive, route, fails, used, success = True, new, 0, at, at
            elif alive:
                used, fails = at, fails + strike
                alive = fails < rules.EVICT_AFTER
        if seen is not None:
            self._keep(timer, alive, route, wins, fails, used, success, seen)
            yield _change(key[0], "learned", route, wins, fails, used, success) if alive else _change(key[0], "gone", seen=seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self.entry.get()
        if entry is not None:
            alive, *_, seen, timer = entry
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                # Every outcome from now on is younger than the watermark, which is past all this key has seen.
                self.entry.clear()
                if alive:
                    yield _change(key[0], "expired", seen=seen)


_changed = Row(*[f.strip().split(" ")[0] for f in _CHANGE.split(",")])


def _change(key, change: str, route=None, wins=None, fails=None, seen=None, success=None) -> Row:
    return _changed(key, change, route, wins, fails, seen, success)


def _as_text(df: DataFrame, column: str) -> DataFrame:
    """Any other type than text travels through the state as JSON."""
    plain = isinstance(df.schema[column].dataType, T.StringType)
    return df if plain else df.withColumn(column, F.to_json(F.struct(F.col(column).alias("v"))))


def _as_before(df: DataFrame, column: str, kind: T.DataType) -> DataFrame:
    if isinstance(kind, T.StringType):
        return df
    return df.withColumn(column, F.from_json(column, T.StructType([T.StructField("v", kind)]))["v"])


def route_changes(stream: DataFrame, ttl_days: float = rules.ROUTE_TTL_DAYS, delay: str = "1 day", order: list[str] | None = None) -> DataFrame:
    """C6 as a stream of changes: key, change, route, wins, consecutive_fails, last_used, last_success.

    ``change`` is ``learned`` (the entry after a micro-batch), ``gone`` (no entry after it), ``expired`` (too old by the
    watermark) or ``late`` (an outcome older than another of its key, which changed nothing; wins and fails tell what it
    was).  Outcomes older than the newest one by more than ``delay`` are dropped by Spark and counted in its metrics.
    """
    ship(stream.sparkSession)
    ties = [c for c in order or [] if c != "ts"]
    kind = stream.schema["route"].dataType
    strike = (~F.col("ok") & F.coalesce(F.col("stop_reason"), F.lit("")).isin(rules.PENALIZED_REASONS)).cast("int")
    events = _as_text(stream.withColumn("ts", F.col("ts").cast("timestamp")), "route").withWatermark("ts", delay).select(
        "key", "ts", F.unix_micros("ts").alias("at"), "ok", strike.alias("strike"), "route", *ties)
    fold = RouteFold(int(ttl_days * 86400 * 1_000_000), ties)
    changes = events.groupBy("key").transformWithState(fold, _CHANGE, "Append", "EventTime")
    return _as_before(changes, "route", kind).select(
        "key", "change", "route", "wins", "consecutive_fails", F.timestamp_micros("used").alias("last_used"),
        F.timestamp_micros("success").alias("last_success"))


def _start(result: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    with setting(result.sparkSession, _PROVIDER, _ROCKSDB):
        return writer.start(path)


def fold_routes_stream(stream: DataFrame, changes_path: str, checkpoint: str, ttl_days: float = rules.ROUTE_TTL_DAYS,
                       delay: str = "1 day", order: list[str] | None = None, available_now: bool = False) -> StreamingQuery:
    """Keep the learned routes of an outcome stream (key, ts, ok, stop_reason, route) up to date.

    The routes themselves are the query's state (:func:`learned_routes`); what changed goes to ``changes_path``.
    """
    return _start(route_changes(stream, ttl_days, delay, order), changes_path, checkpoint, available_now)


def learned_routes(spark: SparkSession, checkpoint: str, ttl_days: float = rules.ROUTE_TTL_DAYS, as_of=None,
                   route_type: T.DataType | None = None) -> DataFrame:
    """The routes known after the last finished micro-batch, read from the query's state.

    Ages are judged against ``as_of``, by default the newest outcome the state has seen.
    """
    state = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint).select("value.*", F.col("key.key").alias("key"))
    if as_of is None:
        now = state.agg(F.max("seen").alias("now"))
        state = state.join(F.broadcast(now))  # One row.
    else:
        state = state.withColumn("now", F.unix_micros(F.lit(as_of).cast("timestamp")))
    entries = state.filter(F.col("alive") & (F.col("now") - F.col("used") <= int(ttl_days * 86400 * 1_000_000))).select(
        "key", "route", "wins", F.col("fails").alias("consecutive_fails"), F.timestamp_micros("used").alias("last_used"),
        F.timestamp_micros("success").alias("last_success"))
    return _as_before(entries, "route", route_type or T.StringType())


def late_outcomes(spark: SparkSession, changes_path: str) -> DataFrame:
    """Outcomes that C6 left out as late: key, ok, route, ts."""
    return spark.read.parquet(changes_path).filter("change = 'late'").select(
        "key", (F.col("wins") > 0).alias("ok"), "route", F.col("last_used").alias("ts"))


class ProviderHealth(StatefulProcessor):
    """First quota error of a (session, provider), and the calls told to be before any."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.dead = handle.getValueState("dead", "seq long", self.keep_ms)
        self.told = handle.getListState("told", "seq long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        calls, held = list(rows), self.dead.get()
        before = held[0] if held is not None else None
        dead = min([c["seq"] for c in calls if c["quota"]] + ([] if before is None else [before]), default=None)
        if dead != before:
            self.dead.update((dead,))
            # A quota error before the known one: calls behind it that were told otherwise are corrected.
            told = [seq for (seq,) in self.told.get()]
            wrong = [seq for seq in told if seq > dead]
            for seq in wrong:
                yield _told(key[0], seq, None, True, 1)
            if told:
                self.told.put([(seq,) for seq in told if seq <= dead]) if len(wrong) < len(told) else self.told.clear()
        alive = [(c["seq"],) for c in calls if dead is None or c["seq"] <= dead]
        if alive:
            self.told.appendList(alive)
        for c in calls:
            yield _told(key[0], c["seq"], c["row"], dead is not None and c["seq"] > dead, 0)


_TOLD = "key string, seq long, row string, dead_before boolean, revision int"
_told = Row("key", "seq", "row", "dead_before", "revision")


def provider_health_stream(stream: DataFrame, out_path: str, checkpoint: str, keep_hours: float | None = None,
                           available_now: bool = False) -> StreamingQuery:
    """C7 on a stream: calls with ``error_class`` and ``dead_before`` as far as known, and corrections to them.

    A row of ``revision`` 0 is a call; one of revision 1 takes back what was told of a call when a quota error with a
    smaller ``seq`` came after it.  :func:`provider_health_now` puts both together.  A (session, provider) is forgotten
    when its state is ``keep_hours`` old; by the clock there is always more to do, so such a query never ends by itself.
    ``seq`` must not be null.
    """
    if keep_hours and available_now:
        raise ValueError("a query that forgets by the clock does not end; leave out keep_hours or available_now")
    ship(stream.sparkSession)
    keys = ["session", "provider"]
    rest = [c for c in [*stream.columns, "error_class"] if c not in (*keys, "seq")]
    classed = classify_errors(stream)
    calls = classed.select(
        F.to_json(F.struct(*keys)).alias("key"), F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("error_class") == "quota", F.lit(False)).alias("quota"), F.to_json(F.struct(*rest)).alias("row"))
    health = ProviderHealth(int(keep_hours * 3_600_000) if keep_hours else None)
    told = calls.groupBy("key").transformWithState(health, _TOLD, "Append", "ProcessingTime" if keep_hours else "None")
    kinds = {n: T.StructType([classed.schema[c] for c in cols]) for n, cols in (("key", keys), ("row", rest))}
    opened = told.withColumns({n: F.from_json(n, kind) for n, kind in kinds.items()})
    return _start(opened.select("key.*", "seq", "row.*", "dead_before", "revision"), out_path, checkpoint, available_now)


def provider_health_now(spark: SparkSession, out_path: str) -> DataFrame:
    """Calls with ``dead_before`` as it stands after all corrections."""
    told = spark.read.parquet(out_path)
    keys = ["session", "provider", "seq"]
    wrong = told.filter("revision = 1").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_wrong", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    calls = told.filter("revision = 0").drop("revision").join(wrong, on, "left")
    return calls.withColumn("dead_before", F.col("dead_before") | F.coalesce("_wrong", F.lit(False))).drop("_wrong", *[f"_{k}" for k in keys])
