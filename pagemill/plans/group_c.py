"""Queries over the fetch log, with their checking SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from .. import rules
from ..operators import fetchlog, routecap
from .sqltext import lit
from .tables import ctes, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _resolved(budget: int | None) -> str:
    over = f"(g = 1 AND n > {budget})" if budget else "false"
    return ctes("attempts") + f""",
a0 AS (SELECT *, CASE WHEN phase IN ('probe','grid') THEN 1 ELSE 0 END AS g FROM attempts),
a1 AS (SELECT *, sum(g) OVER (PARTITION BY request_id ORDER BY seq) AS n FROM a0),
a2 AS (SELECT *, {over} AS over, error IS NULL AND NOT {over} AS answered FROM a1),
a3 AS (SELECT *, answered AND (verdict IN ('strong_ok','weak_ok')
  OR (g = 1 AND verdict IN ('auth_required','not_found','rate_limited'))) AS decisive FROM a2),
st AS (SELECT request_id, min(seq) AS stop_seq FROM a3 WHERE decisive GROUP BY request_id),
live AS (SELECT a3.*, stop_seq FROM a3 LEFT JOIN st USING (request_id)
  WHERE NOT over AND (stop_seq IS NULL OR seq <= stop_seq)),
cut AS (SELECT request_id, bool_or(over) AS cut FROM a3 GROUP BY request_id),
r AS (SELECT request_id, any_value(stop_seq) AS stop_seq,
  max(CASE WHEN seq = stop_seq THEN verdict END) AS sv, max(CASE WHEN seq = stop_seq THEN phase END) AS sp,
  min(CASE WHEN answered AND phase <> 'phase0' AND verdict = 'suspect_ok' THEN seq END) AS sus,
  max(CASE WHEN answered AND g = 1 THEN seq END) AS lastseq, sum(g) AS ex FROM live GROUP BY request_id),
allr AS (SELECT DISTINCT request_id FROM attempts),
f AS (SELECT allr.request_id, r.*, cut.cut, coalesce(sv IN ('strong_ok','weak_ok'), false) AS ok FROM allr
  LEFT JOIN r USING (request_id) LEFT JOIN cut USING (request_id)),
res AS (SELECT f.request_id, ok, CASE WHEN ok THEN stop_seq WHEN sus IS NOT NULL THEN sus
    WHEN stop_seq IS NOT NULL THEN stop_seq ELSE lastseq END AS seq, coalesce(ex, 0)::BIGINT AS executed_attempts,
  CASE WHEN ok THEN 'success' WHEN stop_seq IS NOT NULL THEN sv WHEN cut THEN 'budget' ELSE 'exhausted' END AS stop_reason,
  NOT coalesce(sp IN ('phase0','probe','grid'), false) AND NOT cut AS grid_exhausted FROM f),
resolved AS (SELECT res.request_id, ok, coalesce(a.verdict, 'unknown') AS verdict, a.url, res.seq, executed_attempts,
  stop_reason, grid_exhausted FROM res LEFT JOIN attempts a ON a.request_id = res.request_id AND a.seq = res.seq)
"""


@query("c1_resolve_attempts", _resolved(None) + "SELECT * FROM resolved")
def c1(spark, sf):
    return fetchlog.resolve_attempts(table(spark, sf, "attempts"))


@query("c1_resolve_attempts_budget", _resolved(3) + "SELECT * FROM resolved")
def c1_budget(spark, sf):
    return fetchlog.resolve_attempts(table(spark, sf, "attempts"), max_attempts=3)


@query("c2_next_action", _resolved(3) + """
SELECT request_id, stop_reason, grid_exhausted, CASE WHEN ok THEN NULL
  WHEN stop_reason IN ('auth_required','not_found') THEN 'stop' WHEN stop_reason = 'rate_limited' THEN 'backoff'
  WHEN stop_reason = 'budget' OR NOT grid_exhausted THEN 'resume' ELSE 'render' END AS next_action FROM resolved""")
def c2(spark, sf):
    return fetchlog.next_action(c1_budget(spark, sf)).select(
        "request_id", "stop_reason", "grid_exhausted", "next_action")


@query("c3_summarize_attempts", _resolved(None) + f""",
n AS (SELECT request_id, count(*) AS n, count(*) FILTER (verdict = 'challenge') AS ch, max(profile) AS profile,
  array_to_string(array_agg(verdict ORDER BY seq)[1:5], ',') AS vs FROM attempts GROUP BY request_id)
SELECT request_id, concat('failed after ', n, ' attempts; profile=', coalesce(profile, 'None'), '; stop=', stop_reason,
  '; verdicts=', vs, CASE WHEN n > 5 THEN '...' ELSE '' END) AS summary,
  coalesce(profile IN ({", ".join(lit(p) for p in rules.API_FIRST_PROFILES)}), false) AND ch >= 3 AS api_first
FROM n JOIN resolved USING (request_id)""")
def c3(spark, sf):
    a = table(spark, sf, "attempts")
    return fetchlog.summarize_attempts(a, fetchlog.resolve_attempts(a))


@query("c4_winning_routes", ctes("attempts") + """
SELECT request_id, arg_max(concat_ws('|', url_transform, impersonate, referer, phase), seq) AS route FROM attempts
WHERE verdict IN ('strong_ok','weak_ok') AND phase IN ('probe','grid') AND executor = 'curl_cffi'
  AND impersonate IS NOT NULL GROUP BY request_id""")
def c4(spark, sf):
    r = F.col("route")
    return fetchlog.winning_routes(table(spark, sf, "attempts")).select(
        "request_id", F.concat_ws("|", r["transform"], r["impersonate"], r["referer"], r["phase"]).alias("route"))


_AS_OF = datetime.datetime(2024, 1, 31, tzinfo=datetime.timezone.utc)
_TTL = 3.0
_FOLD = ctes("outcomes").replace("WITH ", "WITH RECURSIVE ", 1) + """,
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM outcomes),
step AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, false AS alive, CAST(NULL AS VARCHAR) AS route, 0 AS wins, 0 AS fails,
    CAST(NULL AS TIMESTAMP) AS last_used, CAST(NULL AS TIMESTAMP) AS last_success FROM outcomes
  UNION ALL
  SELECT key, n, CASE WHEN ok THEN true WHEN NOT was THEN false WHEN hit AND fails + 1 >= 2 THEN false ELSE true END,
    CASE WHEN ok THEN nroute ELSE route END, CASE WHEN ok THEN CASE WHEN was AND nroute = route THEN wins + 1 ELSE 1 END
      ELSE wins END,
    CASE WHEN ok THEN 0 WHEN was AND hit THEN fails + 1 ELSE fails END,
    CASE WHEN ok OR was THEN ts ELSE last_used END, CASE WHEN ok THEN ts ELSE last_success END
  FROM (SELECT o.key, o.n, o.ts, o.ok, o.route AS nroute, o.stop_reason IN ('exhausted','challenge','blocked') AS hit,
      s.alive AND o.ts - s.last_used <= INTERVAL 3 DAY AS was, s.route, s.wins, s.fails, s.last_used, s.last_success
    FROM step s JOIN o ON o.key = s.key AND o.n = s.n + 1)),
fin AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1),
live AS (SELECT key, route, wins, fails, last_used, last_success FROM fin
  WHERE alive AND TIMESTAMP '2024-01-31' - last_used <= INTERVAL 3 DAY)
"""
_SHOW = (
    "SELECT key, route, CAST(wins AS BIGINT) AS wins, CAST(fails AS BIGINT) AS consecutive_fails, "
    "epoch_us(last_used) AS last_used, epoch_us(last_success) AS last_success FROM live"
)


def _store(spark, sf, cap):
    return fetchlog.fold_routes(
        table(spark, sf, "outcomes"), _AS_OF, ttl_days=_TTL, cap=cap, order=["ts", "event_id"])


def _micros(df):
    return df.withColumn("last_used", F.unix_micros("last_used")).withColumn(
        "last_success", F.unix_micros("last_success"))


@query("c5_fold_routes", _FOLD + _SHOW)
def c5(spark, sf):
    return _micros(_store(spark, sf, None))


@query("c5_fold_routes_cap", _FOLD + _SHOW + " ORDER BY live.last_used DESC, key LIMIT 20")
def c5_cap(spark, sf):
    return _micros(_store(spark, sf, 20))


# A cap that holds at every event has no SQL; tests/test_routecap.py folds one event after the other.
@query("c5_fold_routes_lru")
def c5_lru(spark, sf):
    return _micros(routecap.fold_routes_lru(table(spark, sf, "outcomes"), _AS_OF, ttl_days=_TTL, cap=20, order=["ts", "event_id"]))


_QUOTA = "json_extract_string(body, '$.error.details[0].violations[0].quotaId')"
_CLASSED = ctes("provider_calls") + """,
k AS (SELECT *, CASE
  WHEN provider = 'gemini' THEN CASE
    WHEN http_status = 429 OR (http_status = 403 AND contains(body, 'RESOURCE_EXHAUSTED'))
      THEN CASE WHEN contains(body, 'QuotaFailure') AND contains(lower(body), 'perday') THEN 'quota' ELSE 'rate_limited' END
    WHEN http_status >= 500 THEN 'server' WHEN http_status <> 200 THEN 'other' END
  WHEN provider LIKE 'nim%' THEN CASE
    WHEN http_status = 402 OR (http_status = 403 AND (contains(lower(body), 'credit') OR contains(lower(body), 'quota')))
      THEN 'quota' WHEN http_status = 429 THEN 'rate_limited' WHEN http_status <> 200 THEN 'other' END
  ELSE CASE WHEN http_status = 429 THEN 'rate_limited' WHEN http_status IN (401,403) THEN 'auth'
    WHEN http_status IN (400,413) THEN 'rejected' WHEN http_status >= 500 THEN 'server'
    WHEN http_status <> 200 THEN 'other' WHEN NOT contains(body, '"text"') THEN 'parse' END END AS error_class
  FROM provider_calls)
"""


@query("f8_classify_errors", _CLASSED + "SELECT session, seq, provider, http_status, error_class FROM k")
def f8(spark, sf):
    from ..operators.enrich import classify_errors

    return classify_errors(table(spark, sf, "provider_calls")).drop("body")


@query("c7_provider_health", _CLASSED + """
SELECT session, seq, provider, http_status, error_class,
  coalesce(bool_or(error_class = 'quota') OVER (PARTITION BY session, provider ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead_before FROM k""")
def c7(spark, sf):
    return fetchlog.provider_health(table(spark, sf, "provider_calls")).drop("body")


_STORE_SQL = ctes("outcomes", "requests") + """,
store AS (SELECT key, max(route) AS route FROM outcomes WHERE ok GROUP BY key),
r AS (SELECT *, lower(regexp_extract(url, '//([^/?#]*)', 1)) || '::'
  || CASE WHEN device = 'mobile' THEN 'mobile' ELSE 'desktop' END AS key FROM requests)
SELECT event_id, url, device, key, route FROM r LEFT JOIN store USING (key)"""


@query("c8_lookup_routes", _STORE_SQL)
def c8(spark, sf):
    store = table(spark, sf, "outcomes").filter("ok").groupBy("key").agg(
        F.struct(F.max("route").alias("name")).alias("route"))
    found = fetchlog.lookup_routes(table(spark, sf, "requests"), store)
    return found.withColumn("route", F.col("route.name"))


def _stream(spark, sf, name):
    """A derived input as a stream over its base table's files."""
    from .tables import DERIVED

    base, exprs = DERIVED[name]
    path = f"{sf}/{base}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").selectExpr(*exprs)


# The stream judges age against its newest event, so the checking fold does too.
@query("c6_fold_routes_stream", _FOLD.replace(
    "TIMESTAMP '2024-01-31'", "(SELECT max(ts) FROM outcomes)") + _SHOW)
def c6(spark, sf):
    from ..functions.lineage import new_folder
    from ..streaming import folds

    out = new_folder(spark, "routes")
    folds.fold_routes_stream(
        _stream(spark, sf, "outcomes"), out, f"{out}-log", ttl_days=_TTL, order=["ts", "event_id"], available_now=True
    ).awaitTermination()
    return _micros(folds.learned_routes(spark, f"{out}-log", _TTL)).withColumn("consecutive_fails", F.col("consecutive_fails").cast("long"))


@query("c7_provider_health_stream", ORACLES["c7_provider_health"])
def c7_stream(spark, sf):
    from ..functions.lineage import new_folder
    from ..streaming import folds

    out = new_folder(spark, "health")
    folds.provider_health_stream(
        _stream(spark, sf, "provider_calls"), out, f"{out}-log", available_now=True).awaitTermination()
    return folds.provider_health_now(spark, out).drop("body")


@query("a1_load_captures_stream", """
SELECT status, count(*) AS captures FROM (SELECT CASE WHEN page_id % 4 = 0 AND page_id % 3 <> 0 THEN 404 ELSE 200 END AS status
FROM pages) GROUP BY status""")
def a1_stream(spark, sf):
    """Captures read as a stream and written to a table."""
    from ..functions.lineage import new_folder
    from ..sources.captures import parse_captures

    out = new_folder(spark, "captures")
    parse_captures(_stream(spark, sf, "raw_captures")).writeStream.format("parquet").option(
        "checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("status").agg(F.count("*").alias("captures"))
