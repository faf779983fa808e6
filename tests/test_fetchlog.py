import datetime as dt
import random

from pyspark.sql import functions as F

from pagemill.functions import ordered
from pagemill.operators import enrich, fetchlog
from pagemill.streaming import folds

T0 = dt.datetime(2024, 1, 1)
OUTCOME = "key string, ts timestamp, seq long, ok boolean, stop_reason string, route string"


def brute_fold(rows, as_of, ttl, start=None):
    """One event after the other."""
    store = dict(start or {})
    for key, ts, seq, ok, reason, route in sorted(rows, key=lambda r: (r[1], r[2])):
        e = store.get(key)
        if e and ts - e["used"] > ttl:
            del store[key]
            e = None
        if ok:
            wins = e["wins"] + 1 if e and e["route"] == route else 1
            store[key] = {"route": route, "wins": wins, "fails": 0, "used": ts, "success": ts}
        elif e:
            e["used"] = ts
            if reason in ("exhausted", "challenge", "blocked"):
                e["fails"] += 1
                if e["fails"] >= 2:
                    del store[key]
    return {k: e for k, e in store.items() if as_of - e["used"] <= ttl}


def shown(df):
    return {r.key: (r.route, r.wins, r.consecutive_fails, r.last_used, r.last_success) for r in df.collect()}


def expected(store):
    return {k: (e["route"], e["wins"], e["fails"], e["used"], e["success"]) for k, e in store.items()}


def history(seed, n=600, hours=400):
    rng = random.Random(seed)
    # One key holds a third of the events.
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(25)}", T0 + dt.timedelta(minutes=rng.randrange(hours * 60)),
             i, rng.random() < 0.45, rng.choice(["exhausted", "blocked", "rate_limited", "budget"]), rng.choice("AB"))
            for i in range(n)]


def test_fold_equals_one_by_one(spark):
    for seed, ttl, chunk in [(1, 1.0, 3600), (2, 0.5, 86400), (3, 30, 60), (4, 0.25, 600)]:
        rows = history(seed)
        as_of = T0 + dt.timedelta(hours=401)
        df = spark.createDataFrame(rows, OUTCOME).repartition(5)
        got = fetchlog.fold_routes(df, as_of, ttl, None, ["ts", "seq"], chunk)
        assert shown(got) == expected(brute_fold(rows, as_of, dt.timedelta(days=ttl)))


def test_fold_continues_from_a_store(spark):
    rows = sorted(history(7), key=lambda r: (r[1], r[2]))
    ttl, half = dt.timedelta(days=1), len(rows) // 2
    cut_ts = rows[half][1]
    first, second = [r for r in rows if r[1] < cut_ts], [r for r in rows if r[1] >= cut_ts]
    store = fetchlog.fold_routes(spark.createDataFrame(first, OUTCOME), first[-1][1], 1, None, ["ts", "seq"])
    store = spark.createDataFrame(store.collect(), store.schema)
    as_of = rows[-1][1]
    got = fetchlog.fold_routes(
        spark.createDataFrame(second, OUTCOME), as_of, 1, None, ["ts", "seq"], initial=store)
    assert shown(got) == expected(brute_fold(rows, as_of, ttl))


def test_named_cases(spark):
    def run(*events, days=30):
        rows = [("k", T0 + dt.timedelta(hours=i), i, ok, reason, route) for i, (ok, reason, route) in enumerate(events)]
        return shown(fetchlog.fold_routes(spark.createDataFrame(rows, OUTCOME), T0 + dt.timedelta(days=1), days, 500)).get("k")

    win = lambda r: (True, None, r)
    assert run(win("A"), win("A"))[1] == 2 and run(win("A"), win("A"), win("B"))[:2] == ("B", 1)
    assert run(win("A"), (False, "rate_limited", None))[2] == 0 and run(win("A"), (False, "blocked", None))[2] == 1
    assert run(win("A"), (False, "blocked", None), (False, "exhausted", None)) is None
    assert run(win("A"), (False, "blocked", None), win("A"), (False, "blocked", None))[1:3] == (2, 1)
    assert run((False, "blocked", None)) is None
    many = [(f"k{i}", T0 + dt.timedelta(hours=i), i, True, None, "A") for i in range(12)]
    kept = shown(fetchlog.fold_routes(spark.createDataFrame(many, OUTCOME), T0 + dt.timedelta(days=1), 30, 5))
    assert set(kept) == {f"k{i}" for i in range(7, 12)}
    aged = [("old", T0, 0, True, None, "A"), ("even", T0 + dt.timedelta(days=1), 1, True, None, "A")]
    kept = shown(fetchlog.fold_routes(spark.createDataFrame(aged, OUTCOME), T0 + dt.timedelta(days=31), 30, None))
    assert set(kept) == {"even"}


def run_stream(spark, tmp_path, ttl=1, delay="1 day"):
    """One run over what lies in the folder; every run goes on from the checkpoint of the one before."""
    query = folds.fold_routes_stream(
        spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), str(tmp_path / "out"),
        str(tmp_path / "log"), ttl, delay, ["ts", "seq"], available_now=True)
    query.awaitTermination()
    return query


def arrive(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, OUTCOME).coalesce(1).write.parquet(str(tmp_path / "in" / name))


def test_stream_over_several_batches(spark, tmp_path):
    rows = sorted(history(11), key=lambda r: (r[1], r[2]))
    bounds = [0, 200, 201, 450, len(rows)]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        arrive(spark, tmp_path, f"b{i}", rows[a:b])
        run_stream(spark, tmp_path)
    want = expected(brute_fold(rows, rows[-1][1], dt.timedelta(days=1)))
    assert shown(folds.learned_routes(spark, str(tmp_path / "log"), 1)) == want
    # A run without data changes nothing.
    run_stream(spark, tmp_path)
    assert shown(folds.learned_routes(spark, str(tmp_path / "log"), 1)) == want
    assert folds.late_outcomes(spark, str(tmp_path / "out")).count() == 0


def late_fold(batches, ttl, delay):
    """The model of the stream: per key, outcomes older than one before them are late; too old ones are dropped."""
    store, seen, late, watermark = {}, {}, [], dt.datetime.min
    for batch in batches:
        for row in sorted((r for r in batch if r[1] >= watermark), key=lambda r: (r[1], r[2])):
            if row[1] < seen.get(row[0], dt.datetime.min):
                late.append((row[0], row[1], row[3], row[5]))
                continue
            seen[row[0]] = row[1]
            one = brute_fold([row], row[1], ttl, {k: e for k, e in store.items() if k == row[0]})
            store.pop(row[0], None)
            store.update(one)
        watermark = max([watermark, *(r[1] - delay for r in batch)])
        # What the watermark has passed is forgotten: nothing older can come.
        store = {k: e for k, e in store.items() if e["used"] + ttl >= watermark}
    newest = max(r[1] for b in batches for r in b)
    return {k: e for k, e in store.items() if newest - e["used"] <= ttl}, sorted(late)


def test_stream_out_of_order(spark, tmp_path):
    """Batches that overlap in time: tombstones keep an evicted entry from being learned from older outcomes."""
    rng = random.Random(21)
    rows = sorted(history(31, n=500, hours=200), key=lambda r: (r[1], r[2]))
    batches = [[] for _ in range(6)]
    for i, r in enumerate(rows):
        batches[min(5, max(0, i * 6 // len(rows) + rng.choice([0, 0, 0, 0, 1])))].append(r)
    ttl, delay = dt.timedelta(days=2), dt.timedelta(days=3)
    for i, batch in enumerate(batches):
        arrive(spark, tmp_path, f"b{i}", batch)
        run_stream(spark, tmp_path, 2, "3 days")
    store, late = late_fold(batches, ttl, delay)
    assert late and shown(folds.learned_routes(spark, str(tmp_path / "log"), 2)) == expected(store)
    assert sorted(tuple(r) for r in folds.late_outcomes(spark, str(tmp_path / "out")).select("key", "ts", "ok", "route").collect()) == late


def test_evicted_entries_have_a_memory_and_expired_ones_go(spark, tmp_path):
    def at(h):
        return T0 + dt.timedelta(hours=h)

    arrive(spark, tmp_path, "a", [("k", at(1), 1, True, None, "A"), ("k", at(2), 2, False, "blocked", None), ("k", at(3), 3, False, "blocked", None),
                                  ("old", at(0), 4, True, None, "B")])
    run_stream(spark, tmp_path, 1, "5 days")
    # Older than the eviction: late, not new.
    arrive(spark, tmp_path, "b", [("k", at(2.5), 5, True, None, "Z")])
    run_stream(spark, tmp_path, 1, "5 days")
    assert set(shown(folds.learned_routes(spark, str(tmp_path / "log"), 1))) == {"old"}
    assert [(r.key, r.route, r.ok) for r in folds.late_outcomes(spark, str(tmp_path / "out")).collect()] == [("k", "Z", True)]
    # Ten days on the watermark has passed both; a younger outcome of the evicted key is learned.
    arrive(spark, tmp_path, "c", [("k", at(4), 6, True, None, "C"), ("new", at(240), 7, True, None, "N")])
    run_stream(spark, tmp_path, 1, "5 days")
    run_stream(spark, tmp_path, 1, "5 days")
    state = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "log"))
    assert [r["key"]["key"] for r in state.select("key").collect()] == ["new"]
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.key, r.change) for r in changes.collect()} >= {("k", "gone"), ("k", "learned"), ("k", "expired"), ("old", "expired"), ("new", "learned")}


def test_a_batch_touches_its_own_keys_only(spark, tmp_path):
    arrive(spark, tmp_path, "a", [(f"k{i}", T0 + dt.timedelta(seconds=i), i, True, None, "A") for i in range(300)])
    run_stream(spark, tmp_path, 30)
    arrive(spark, tmp_path, "b", [("k7", T0 + dt.timedelta(hours=1), 1000, True, None, "A")])
    query = run_stream(spark, tmp_path, 30)
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in (q.json and __import__("json").loads(q.json) for q in query.recentProgress) if p["numInputRows"]]
    assert updated and max(updated) <= 10
    assert len(shown(folds.learned_routes(spark, str(tmp_path / "log"), 30))) == 300
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert changes.count() == 301


def test_routes_that_are_structs(spark, tmp_path):
    rows = [("k", T0 + dt.timedelta(hours=h), h, True, None, ("t", v)) for h, v in enumerate([1, 1, 2])]
    schema = OUTCOME.replace("route string", "route struct<name:string,n:int>")
    frame = spark.createDataFrame(rows, schema)
    frame.write.parquet(str(tmp_path / "in"))
    folds.fold_routes_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"),
                             order=["ts", "seq"], available_now=True).awaitTermination()
    got = folds.learned_routes(spark, str(tmp_path / "log"), route_type=frame.schema["route"].dataType).first()
    assert (got.route.name, got.route.n, got.wins) == ("t", 2, 1)
    assert spark.read.parquet(str(tmp_path / "out")).first().route.n == 2


def test_no_route_is_forgotten_by_default(spark):
    many = [(f"k{i}", T0 + dt.timedelta(seconds=i), i, True, None, "A") for i in range(700)]
    assert fetchlog.fold_routes(spark.createDataFrame(many, OUTCOME), T0 + dt.timedelta(days=1)).count() == 700


def test_ordered_values_over_chunks(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randrange(5), rng.choice([None, "x", "y"])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, seq long, n long, v string").repartition(6)
    got = {(r.k, r.seq): (r.total, r.before) for r in ordered.ordered_values(
        df, ["k"], ["seq"], ordered.chunk_of("seq", 16), {"total": F.col("n")}, {"before": F.col("v")}).collect()}
    totals, last = {}, {}
    for k, seq, n, v in rows:
        totals[k] = totals.get(k, 0) + n
        assert got[(k, seq)] == (totals[k], last.get(k))
        last[k] = v or last.get(k)
    lo = {(r.k, r.seq): r.lo for r in ordered.group_values(
        df, ["k"], {"lo": ("min", F.col("n") + F.col("seq"))}, ordered.chunk_of("seq", 16)).collect()}
    for k, seq, n, v in rows:
        assert lo[(k, seq)] == min(m + s for kk, s, m, _ in rows if kk == k)


ATTEMPT = ("request_id long, seq long, phase string, executor string, url string, url_transform string, "
           "impersonate string, referer string, verdict string, error string")


def attempts(spark, *verdicts, phases=None, errors=()):
    rows = [(1, i, (phases or ["probe"] + ["grid"] * 20)[i], "curl_cffi", f"u{i}", "original", "a", "r", v,
             "x" if i in errors else None) for i, v in enumerate(verdicts)]
    return spark.createDataFrame(rows, ATTEMPT)


def test_attempts(spark):
    def run(*v, budget=None, **kw):
        r = fetchlog.next_action(fetchlog.resolve_attempts(attempts(spark, *v, **kw), budget)).first()
        return r.ok, r.verdict, r.seq, r.executed_attempts, r.stop_reason, r.grid_exhausted, r.next_action

    assert run("challenge", "weak_ok", "blocked") == (True, "weak_ok", 1, 2, "success", False, None)
    assert run("blocked", "not_found", "weak_ok") == (False, "not_found", 1, 2, "not_found", False, "stop")
    assert run("suspect_ok", "suspect_ok", "blocked") == (False, "suspect_ok", 0, 3, "exhausted", True, "render")
    assert run("blocked", "rate_limited") == (False, "rate_limited", 1, 2, "rate_limited", False, "backoff")
    assert run("blocked", "challenge", "weak_ok", budget=2) == (False, "challenge", 1, 2, "budget", False, "resume")
    assert run("blocked", "unknown", errors=(1,)) == (False, "blocked", 0, 2, "exhausted", True, "render")
    phases = ["phase0", "probe", "fallback"]
    assert run("strong_ok", phases=phases)[:5] == (True, "strong_ok", 0, 0, "success")
    assert run("blocked", "challenge", "strong_ok", phases=phases)[:6] == (True, "strong_ok", 2, 1, "success", True)
    df = attempts(spark, *["challenge"] * 6).withColumn("profile", F.lit("aws_waf"))
    s = fetchlog.summarize_attempts(df, fetchlog.resolve_attempts(df)).first()
    assert s.api_first and s.summary == (
        "failed after 6 attempts; profile=aws_waf; stop=exhausted; verdicts=" + ",".join(["challenge"] * 5) + "...")


def test_winning_route(spark):
    df = attempts(spark, "challenge", "weak_ok", "weak_ok")
    route = fetchlog.winning_routes(df).first().route
    assert (route.transform, route.phase) == ("original", "grid")
    assert fetchlog.winning_routes(df.withColumn("executor", F.lit("browser"))).count() == 0
    keys = spark.createDataFrame([("https://H:1/x", "auto"), ("https://h:1/", "mobile")], "url string, device string")
    got = [r.k for r in keys.select(fetchlog.route_key(F.col("url"), F.col("device")).alias("k")).collect()]
    assert got == ["h:1::desktop", "h:1::mobile"]


def quota(kind):
    return ('{"error":{"details":[{"@type":"type.googleapis.com/google.rpc.QuotaFailure","violations":[{"quotaId":"'
            + kind + '"}]}]}}')


def test_provider_errors(spark, tmp_path):
    rows = [
        ("gemini", 429, quota("GenerateRequestsPerDayPerProject"), "quota"),
        ("gemini", 429, quota("GenerateRequestsPerMinute"), "rate_limited"), ("gemini", 429, "{}", "rate_limited"),
        ("gemini", 403, "RESOURCE_EXHAUSTED", "rate_limited"), ("gemini", 400, "", "other"), ("gemini", 200, "", None),
        ("nim_gemma4", 402, "", "quota"), ("nim_gemma4", 403, "no Credit", "quota"), ("nim_gemma4", 403, "", "other"),
        ("nim_gemma4", 429, "", "rate_limited"), ("groq", 401, "", "auth"), ("groq", 413, "", "rejected"),
        ("groq", 502, "", "server"), ("groq", 418, "", "other"), ("groq", 200, "x", "parse"),
        ("groq", 200, '{"text":"t"}', None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "seq long, provider string, http_status int, body string, want string")
    for r in enrich.classify_errors(df).collect():
        assert r.error_class == r.want, r
    health = {r.seq: r.dead_before for r in fetchlog.provider_health(df.withColumn("session", F.lit(1))).collect()}
    assert [health[i] for i in range(10)] == [False] + [True] * 5 + [False] + [True] * 3
    # The same over batches of a stream, in order and out of it: late quota errors correct what was told before.
    calls = df.withColumn("session", F.lit(1)).drop("want")
    for order, cuts in enumerate([["seq < 3", "seq >= 3"], ["seq >= 9", "seq IN (2, 4, 7)", "seq IN (1, 3, 5, 8)", "seq IN (0, 6)"]]):
        base = tmp_path / str(order)
        for i, cond in enumerate(cuts):
            calls.filter(cond).write.parquet(str(base / "in" / str(i)))
            folds.provider_health_stream(
                spark.readStream.schema(calls.schema).parquet(f"{base}/in/*"), str(base / "o"), str(base / "l"), available_now=True).awaitTermination()
        got = folds.provider_health_now(spark, str(base / "o"))
        assert {r.seq: r.dead_before for r in got.collect()} == health and got.count() == len(health)
        assert {r.seq: (r.http_status, r.body) for r in got.collect()} == {r.seq: (r.http_status, r.body) for r in calls.collect()}
        assert (spark.read.parquet(str(base / "o")).filter("revision = 1").count() > 0) == bool(order)


class _Kept:
    """A state value, list or timer in memory."""

    def __init__(self):
        self.held = None

    def get(self):
        return self.held if self.held is not None else None

    def update(self, value):
        self.held = value


class _Handle:
    def getValueState(self, *_):
        return _Kept()

    def registerTimer(self, at):
        self.timer = at

    def deleteTimer(self, at):
        pass


def test_streams_fold_plain_rows():
    """A key costs no data frame: rows come and go as they are, nulls among the ties last."""
    from pyspark.sql import Row

    from pagemill.streaming import folds

    fold = folds.RouteFold(10**12, ["event_id"])
    fold.init(_Handle())
    event = Row("at", "ok", "strike", "route", "event_id")
    out = list(fold.handleInputRows(("k",), iter([event(5, True, 0, "c", None), event(5, True, 0, "b", 2), event(1, True, 0, "a", 9)]), None))
    assert [(r.change, r.route, r.wins, r.used) for r in out] == [("learned", "c", 1, 5)]
    late = list(fold.handleInputRows(("k",), iter([event(4, False, 1, "x", 1)]), None))
    assert [(r.change, r.wins, r.consecutive_fails) for r in late] == [("late", 0, 1), ("learned", 1, 0)]
