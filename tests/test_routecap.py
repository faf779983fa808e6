"""The cap at every event against one event after the other."""

import datetime as dt
import random

import pytest
from pagemill.operators import routecap

T0 = dt.datetime(2024, 1, 1)
OUTCOME = "key string, ts timestamp, seq long, ok boolean, stop_reason string, route string"


def brute_fold(rows, as_of, ttl, cap, start=()):
    """One event after the other; the store is in order of use."""
    store = {e[0]: list(e[1:]) for e in start}
    for key, ts, _, ok, reason, route in sorted(rows, key=lambda r: (r[1], r[2])):
        store = {k: e for k, e in store.items() if ts - e[3] <= ttl}
        e = store.get(key)
        if ok:
            store.pop(key, None)
            store[key] = [route, e[1] + 1 if e and e[0] == route else 1, 0, ts, ts]
            while len(store) > cap:
                del store[min(store, key=lambda k: list(store).index(k))]
        elif e:
            del store[key]
            e[3] = ts
            e[2] += reason in ("exhausted", "challenge", "blocked")
            if e[2] < 2:
                store[key] = e
    return {k: tuple(e) for k, e in store.items() if as_of - e[3] <= ttl}


def history(seed, n=900, keys=60, wins=0.4):
    rng = random.Random(seed)
    # One key holds a third of the events; some times come twice.
    return [("hot" if rng.random() < 0.34 else f"k{int(keys * rng.random() ** 2)}", T0 + dt.timedelta(minutes=rng.randrange(24000)), i,
             rng.random() < wins, rng.choice(["exhausted", "rate_limited", "budget", "budget"]), rng.choice("AAAB")) for i in range(n)]


def shown(df):
    return {r.key: (r.route, r.wins, r.consecutive_fails, r.last_used, r.last_success) for r in df.collect()}


@pytest.mark.parametrize(("seed", "cap", "ttl", "per_slice", "wins"), [
    (1, 7, 30, 120, 0.4), (2, 12, 2, 60, 0.3), (3, 3, 30, 200, 0.15), (4, 55, 30, 130, 0.6), (5, 20, 30, 2000, 0.4), (6, 1, 1, 300, 0.5)])
def test_cap_at_every_event(spark, seed, cap, ttl, per_slice, wins):
    rows = history(seed, wins=wins)
    as_of, limit = max(r[1] for r in rows), dt.timedelta(days=ttl)
    got = routecap.fold_routes_lru(spark.createDataFrame(rows, OUTCOME).repartition(3), as_of, ttl, cap, ["ts", "seq"], slice_events=per_slice)
    assert shown(got) == brute_fold(rows, as_of, limit, cap)


def test_differs_from_a_cap_at_the_end():
    """A failure of a route that was pushed out does not bring it back."""
    rows = [("a", T0, 0, True, None, "A"), ("b", T0 + dt.timedelta(1), 1, True, None, "A"), ("c", T0 + dt.timedelta(2), 2, True, None, "A"),
            ("a", T0 + dt.timedelta(3), 3, False, "budget", None)]
    assert set(brute_fold(rows, T0 + dt.timedelta(3), dt.timedelta(30), 2)) == {"b", "c"}


def test_continues_from_a_store_and_empty_log(spark):
    rows = sorted(history(9), key=lambda r: (r[1], r[2]))
    half = rows[450][1]
    first, second = [r for r in rows if r[1] < half], [r for r in rows if r[1] >= half]
    store = routecap.fold_routes_lru(spark.createDataFrame(first, OUTCOME), half, 30, 9, ["ts", "seq"], slice_events=100)
    store = spark.createDataFrame(store.collect(), store.schema)
    as_of = rows[-1][1]
    got = routecap.fold_routes_lru(spark.createDataFrame(second, OUTCOME), as_of, 30, 9, ["ts", "seq"], initial=store, slice_events=150)
    assert shown(got) == brute_fold(rows, as_of, dt.timedelta(30), 9)
    none = spark.createDataFrame([], OUTCOME)
    assert routecap.fold_routes_lru(none, as_of).collect() == []
    assert shown(routecap.fold_routes_lru(none, half, 30, 9, initial=store)) == shown(store)


def test_routes_that_are_structs(spark):
    rows = [("k", T0 + dt.timedelta(hours=h), h, True, None, ("t", v)) for h, v in enumerate([1, 2, 2])]
    frame = spark.createDataFrame(rows, OUTCOME.replace("route string", "route struct<name:string,n:int>"))
    got = routecap.fold_routes_lru(frame, T0 + dt.timedelta(1), order=["ts", "seq"], slice_events=1).first()
    assert (got.route.name, got.route.n, got.wins) == ("t", 2, 2)
