"""Fetch-log analytics.

A request, host or session may own a large part of the log.  Ordered values come from
:mod:`pagemill.functions.ordered`, and everything per key is an aggregate Spark combines before the shuffle.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import ordered
from ..functions.text import netloc_of
from .enrich import classify_errors

_GRID = ("probe", "grid")


def resolve_attempts(attempts: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """One row per ``request_id``: how the request ended and which attempt stands for it.

    In ``seq`` order the first good verdict succeeds; auth_required, not_found and rate_limited stop probe and grid;
    probe and grid rows beyond ``max_attempts`` are left out (budget).  On failure the first suspect_ok attempt is
    reported, else the last probe/grid attempt that had a response (``error`` is null).
    """
    numbered = ordered.ordered_values(
        attempts, ["request_id"], ["seq"], ordered.chunk_of("seq"),
        running={"_n": F.when(F.col("phase").isin(*_GRID), 1).otherwise(0)})
    in_grid = F.col("phase").isin(*_GRID)
    over = (in_grid & (F.col("_n") > max_attempts)) if max_attempts is not None else F.lit(False)
    answered = F.col("error").isNull() & ~over
    good = answered & F.col("verdict").isin(rules.OK_VERDICTS)
    wall = answered & in_grid & F.col("verdict").isin(rules.TERMINAL_VERDICTS)
    shown = F.struct("seq", "verdict", "url", "phase", "_n")
    per = numbered.groupBy("request_id").agg(
        F.min(F.when(good | wall, shown)).alias("stop"),
        F.min(F.when(answered & (F.col("phase") != "phase0") & (F.col("verdict") == "suspect_ok"), shown)).alias("sus"),
        F.max(F.when(answered & in_grid, shown)).alias("last"),
        F.max("_n").alias("kept"),
        F.coalesce(F.bool_or(over), F.lit(False)).alias("cut"),
    )
    stop, suspect, last = F.col("stop"), F.col("sus"), F.col("last")
    success = F.coalesce(stop["verdict"].isin(rules.OK_VERDICTS), F.lit(False))
    early = F.coalesce(stop["phase"].isin("phase0", *_GRID), F.lit(False))
    use_suspect = suspect.isNotNull() & (stop.isNull() | (suspect["seq"] < stop["seq"]))
    chosen = F.when(success, stop).when(use_suspect, suspect).when(stop.isNotNull(), stop).otherwise(last)
    executed = F.coalesce(stop["_n"], F.col("kept"))
    if max_attempts is not None:
        executed = F.least(executed, F.lit(max_attempts))
    return per.select(
        "request_id",
        success.alias("ok"),
        F.coalesce(chosen["verdict"], F.lit("unknown")).alias("verdict"),
        chosen["url"].alias("url"),
        chosen["seq"].alias("seq"),
        executed.cast("long").alias("executed_attempts"),
        F.when(success, "success").when(stop.isNotNull(), stop["verdict"]).when(F.col("cut"), "budget")
        .otherwise("exhausted").alias("stop_reason"),
        (~early & ~F.col("cut")).alias("grid_exhausted"),
    )


def next_action(resolved: DataFrame) -> DataFrame:
    """What remains to be done for a request that failed; null after a success."""
    reason = F.col("stop_reason")
    return resolved.withColumn(
        "next_action",
        F.when(F.col("ok"), None)
        .when(reason.isin("auth_required", "not_found"), "stop")
        .when(reason == "rate_limited", "backoff")
        .when((reason == "budget") | ~F.col("grid_exhausted"), "resume")
        .otherwise("render"),
    )


def summarize_attempts(attempts: DataFrame, resolved: DataFrame, profile: str = "profile") -> DataFrame:
    """``summary`` line and ``api_first`` flag per request.

    ``attempts`` may carry a ``profile`` column; ``resolved`` is the result of :func:`resolve_attempts`.
    """
    has_profile = profile in attempts.columns
    numbered = ordered.ordered_values(
        attempts, ["request_id"], ["seq"], ordered.chunk_of("seq"), running={"_n": F.lit(1)})
    first = [F.max(F.when(F.col("_n") == i, F.col("verdict"))).alias(f"_v{i}") for i in range(1, 6)]
    per = numbered.groupBy("request_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("verdict") == "challenge").alias("challenges"),
        (F.max(profile) if has_profile else F.lit(None).cast("string")).alias("profile"),
        *first,
    )
    joined = per.join(resolved.select("request_id", "stop_reason"), "request_id")
    shown = F.concat_ws(",", *[F.col(f"_v{i}") for i in range(1, 6)])
    summary = F.concat(
        F.lit("failed after "), F.col("n"), F.lit(" attempts; profile="), F.coalesce("profile", F.lit("None")),
        F.lit("; stop="), F.col("stop_reason"), F.lit("; verdicts="), shown,
        F.when(F.col("n") > 5, "...").otherwise(""))
    api_first = F.coalesce(F.col("profile").isin(rules.API_FIRST_PROFILES), F.lit(False)) & (
        F.col("challenges") >= rules.API_FIRST_CHALLENGES)
    return joined.select("request_id", summary.alias("summary"), api_first.alias("api_first"))


def winning_routes(attempts: DataFrame, http_executor: str = "curl_cffi") -> DataFrame:
    """C4: route of the last good probe/grid attempt over plain HTTP; requests won by a browser have none."""
    learnable = (
        F.col("verdict").isin(rules.OK_VERDICTS) & F.col("phase").isin(*_GRID)
        & (F.col("executor") == http_executor) & (F.coalesce("impersonate", F.lit("")) != "")
    )
    route = F.struct(F.col("url_transform").alias("transform"), "impersonate", "referer", "phase")
    wins = attempts.groupBy("request_id").agg(F.max_by(F.when(learnable, route), F.when(learnable, F.col("seq")))
                                              .alias("route"))
    return wins.filter("route is not null")


def route_key(url: Column, device: Column) -> Column:
    return F.concat(F.lower(netloc_of(url)), F.lit("::"), F.when(device == "mobile", "mobile").otherwise("desktop"))


def _stored_events(entries: DataFrame) -> DataFrame:
    """Stored entries as the events that lead to them: a success of their wins, then a strike or a refresh."""
    strike = F.when(F.col("consecutive_fails") > 0, F.lit(1)).otherwise(0)
    return entries.select("key", F.explode(F.array(
        F.struct(F.col("last_success").alias("ts"), F.lit(0).alias("_turn"), F.lit(True).alias("ok"), F.col("route"),
                 F.lit(0).alias("_strike"), F.col("wins").cast("long").alias("_weight")),
        F.struct(F.col("last_used").alias("ts"), F.lit(1).alias("_turn"), F.lit(False).alias("ok"), F.col("route"),
                 strike.alias("_strike"), F.lit(0).cast("long").alias("_weight")),
    )).alias("e")).select("key", "e.*")


def fold_routes(outcomes: DataFrame, as_of: datetime.datetime | Column, ttl_days: float = rules.ROUTE_TTL_DAYS,
                cap: int | None = None, order: list[str] | None = None, chunk_seconds: int = 3600,
                initial: DataFrame | None = None) -> DataFrame:
    """The learned route per ``key`` after all ``outcomes`` (key, ts, ok, stop_reason, route).

    Two real failures in a row evict an entry, an age above ``ttl_days`` at the next event (or at ``as_of``) ends it,
    other failures only refresh it.  All live keys are kept; a ``cap`` keeps the most recently used, once, at the end.  ``ts`` must not be null; ties are broken by the ``order`` columns after it.
    ``initial`` holds entries from an earlier fold, whose events all came before.

    An entry's state follows from its last success, the strikes and age gaps after it, and the last success at which
    counting started again.  Each (key, hour) is reduced to those values first, hours are then linked per key, so a
    hot key's events spread over many tasks and are read once.
    """
    ties = [c for c in order or [] if c != "ts"]
    limit = F.lit(int(ttl_days * 86400 * 1_000_000))
    strike = (~F.col("ok") & F.coalesce(F.col("stop_reason"), F.lit("")).isin(rules.PENALIZED_REASONS)).cast("int")
    events = outcomes.select(
        "key", F.col("ts").cast("timestamp").alias("ts"), F.lit(2).alias("_turn"), "ok", "route", *ties,
        strike.alias("_strike"), F.col("ok").cast("long").alias("_weight"))
    if initial is not None:
        events = events.unionByName(_stored_events(initial), allowMissingColumns=True)
    events = events.withColumn("_hour", F.floor(F.unix_seconds("ts") / chunk_seconds))
    order, on = ["ts", "_turn", *ties], ["key", "_hour"]
    at = F.struct(*order)

    def starts_again(state: Column, strikes: Column, gaps: Column, route: Column) -> Column:
        return (
            state.isNull() | ~state["route"].eqNullSafe(route) | (strikes - state["strikes"] >= rules.EVICT_AFTER)
            | (gaps > state["gaps"]))

    # Inside an hour: age gaps, running counts, and successes that start counting again.
    w = W.partitionBy(*on).orderBy(*order)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    age = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    rows = events.withColumn("_gap", F.coalesce((age > limit).cast("int"), F.lit(0)))
    rows = rows.withColumns({
        "strikes": F.sum("_strike").over(upto), "gaps": F.sum("_gap").over(upto), "wins": F.sum("_weight").over(upto)})
    rows = rows.withColumn("_last", F.last(
        F.when(F.col("ok"), F.struct("strikes", "gaps", "route")), ignorenulls=True).over(before))
    inner = F.col("ok") & F.col("_last").isNotNull() & starts_again(
        F.col("_last"), F.col("strikes"), F.col("gaps"), F.col("route"))
    earlier = (F.col("wins") - F.col("_weight")).alias("earlier")
    hours = rows.groupBy(*on).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum("_strike").alias("n_strikes"), F.sum("_gap").alias("n_gaps"), F.sum("_weight").alias("n_wins"),
        F.min(F.when(F.col("ok") & F.col("_last").isNull(), F.struct(
            at.alias("at"), "strikes", "gaps", earlier, "route"))).alias("head"),
        F.max(F.when(inner, F.struct(at.alias("at"), earlier))).alias("inner"),
        F.max(F.when(F.col("ok"), F.struct(at.alias("at"), "ts", "strikes", "gaps", "wins", "route"))).alias("tail"))

    # Between the hours of a key: the same, from the summaries.
    k = W.partitionBy("key").orderBy("_hour")
    past = k.rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    wait = F.unix_micros("first_ts") - F.lag(F.unix_micros("last_ts")).over(k)
    linked = hours.withColumn("_gap0", F.coalesce((wait > limit).cast("int"), F.lit(0)))
    linked = linked.withColumns({
        "_s": so_far("n_strikes"), "_n": so_far("n_wins"),
        "_g": so_far(F.col("n_gaps") + F.col("_gap0")) + F.col("_gap0")})
    linked = linked.withColumn("_carried", F.last(F.when(F.col("tail").isNotNull(), F.struct(
        (F.col("_s") + F.col("tail.strikes")).alias("strikes"), (F.col("_g") + F.col("tail.gaps")).alias("gaps"),
        F.col("tail.route").alias("route"))), ignorenulls=True).over(past))
    head_starts = F.col("head").isNotNull() & starts_again(
        F.col("_carried"), F.col("_s") + F.col("head.strikes"), F.col("_g") + F.col("head.gaps"), F.col("head.route"))
    start = F.when(F.col("inner").isNotNull(), F.struct(
        F.col("inner.at").alias("at"), (F.col("_n") + F.col("inner.earlier")).alias("earlier"))).when(
        head_starts, F.struct(F.col("head.at").alias("at"), (F.col("_n") + F.col("head.earlier")).alias("earlier")))
    per = linked.groupBy("key").agg(
        F.max(F.when(F.col("tail").isNotNull(), F.struct(
            F.col("tail.at").alias("at"), F.col("tail.ts").alias("ts"), F.col("tail.route").alias("route"),
            (F.col("_s") + F.col("tail.strikes")).alias("strikes"), (F.col("_g") + F.col("tail.gaps")).alias("gaps"),
            (F.col("_n") + F.col("tail.wins")).alias("wins")))).alias("win"),
        F.max(start).alias("start"),
        F.sum("n_strikes").alias("strikes"), F.sum(F.col("n_gaps") + F.col("_gap0")).alias("gaps"),
        F.max("last_ts").alias("last_used"))
    fails = F.col("strikes") - F.col("win.strikes")
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    fresh = F.unix_micros(now.cast("timestamp")) - F.unix_micros("last_used") <= limit
    alive = per.filter(
        F.col("win").isNotNull() & (fails < rules.EVICT_AFTER) & (F.col("gaps") == F.col("win.gaps")) & fresh)
    entries = alive.select(
        "key", F.col("win.route").alias("route"), (F.col("win.wins") - F.col("start.earlier")).alias("wins"),
        fails.alias("consecutive_fails"), "last_used", F.col("win.ts").alias("last_success"))
    if cap is None:
        return entries
    return entries.orderBy(F.col("last_used").desc(), "key").limit(cap)


def provider_health(calls: DataFrame) -> DataFrame:
    """``error_class`` per call and ``dead_before``: a quota error of that provider came earlier in the session."""
    classed = classify_errors(calls)
    quota = F.when(F.col("error_class") == "quota", F.col("seq"))
    dated = ordered.group_values(
        classed, ["session", "provider"], {"_dead_at": ("min", quota)}, ordered.chunk_of("seq"))
    return dated.withColumn("dead_before", F.coalesce(F.col("seq") > F.col("_dead_at"), F.lit(False))).drop("_dead_at")


def lookup_routes(requests: DataFrame, store: DataFrame, url: str = "url", device: str = "device") -> DataFrame:
    """Attach the stored ``route`` of a request's host and device class; reading refreshes nothing."""
    keyed = requests.withColumn("key", route_key(F.col(url), F.col(device)))
    usable = store.filter("route is not null").select("key", "route")
    return ordered.lookup(keyed, usable, ["key"])
