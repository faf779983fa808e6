"""Queries over threaded posts, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import threads
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


def _found(spark, sf):
    return threads.iter_thread_posts(table(spark, sf, "payloads"), payload="body")


@query("d1_iter_thread_posts", """
SELECT conv_id, turn, concat(conv_id, '-', turn) AS id FROM conversations
UNION ALL SELECT conv_id, turn, concat('q', conv_id, '-', turn) FROM conversations""")
def d1(spark, sf):
    return _found(spark, sf).select("conv_id", "turn", F.try_variant_get("post", "$.id", "string").alias("id"))


@query("d2_parse_posts", """
SELECT conv_id, turn, concat(conv_id, '-', turn) AS id, concat('k', turn) AS code, concat('t', length(text)) AS text,
  role AS author, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END AS likes, turn AS reply_count
FROM conversations WHERE turn % 7 <> 6 AND turn % 5 <> 4
UNION ALL SELECT conv_id, turn, concat('q', conv_id, '-', turn), NULL, NULL, 'q', 0, 0 FROM conversations""")
def d2(spark, sf):
    return threads.parse_posts(_found(spark, sf)).select(
        "conv_id", "turn", "id", "code", "text", "author", "likes", "reply_count")


@query("d3_select_media", """
SELECT concat(conv_id, '-', turn) AS id, 'c' AS images, '' AS videos FROM conversations
UNION ALL SELECT concat('q', conv_id, '-', turn), 'd', 'v2' FROM conversations""")
def d3(spark, sf):
    return threads.select_media(_found(spark, sf)).select(
        F.try_variant_get("post", "$.id", "string").alias("id"), F.array_join("images", ",").alias("images"),
        F.array_join("videos", ",").alias("videos"))


@query("d4_merge_posts", ctes("sightings") + """
SELECT thread_id, id, arg_max(author, seq) AS author, arg_max(text, seq) AS text, arg_max(likes, seq) AS likes,
  min(seq) AS first_seq FROM sightings WHERE id IS NOT NULL GROUP BY thread_id, id""")
def d4(spark, sf):
    return threads.merge_posts(table(spark, sf, "sightings")).drop("seq")


_ASSESSED = """,
ass AS (SELECT thread_id, bool_or(code = root_code) AS root_found,
  coalesce(max(CASE WHEN code = root_code THEN reply_count END), 0) AS expected,
  count(*) FILTER (code <> root_code) AS captured FROM thread_posts GROUP BY thread_id)
"""


@query("d5_assess_completeness", ctes("thread_posts") + _ASSESSED + """
SELECT thread_id, root_found, expected, captured, root_found AND captured < expected AS incomplete FROM ass""")
def d5(spark, sf):
    return threads.assess_completeness(table(spark, sf, "thread_posts"))


@query("d5_assess_orders", """
SELECT o_orderkey AS thread_id, true AS root_found, 1 + o_custkey % 7 AS expected, count(l_orderkey) AS captured,
  count(l_orderkey) < 1 + o_custkey % 7 AS incomplete
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def d5_orders(spark, sf):
    roots = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS thread_id", "'root' AS root_code", "0 AS seq", "'root' AS code", "1 + o_custkey % 7 AS reply_count")
    replies = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS thread_id", "'root' AS root_code", "l_linenumber AS seq",
        "concat('l', l_linenumber) AS code", "0L AS reply_count")
    return threads.assess_completeness(roots.unionByName(replies))


@query("d6_expand_frontier", ctes("leads", "visited_pages") + """,
v AS (SELECT DISTINCT crawl_id, url FROM visited_pages),
f AS (SELECT crawl_id, concat('https://www.threads.net/@', author, '/post/', code) AS url, min(seq) AS found_at
  FROM leads WHERE reply_count > 0 AND code IS NOT NULL GROUP BY ALL),
n AS (SELECT f.* FROM f ANTI JOIN v USING (crawl_id, url)),
r AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY found_at, url) AS visit_no FROM n)
SELECT crawl_id, url, CAST(visit_no AS INT) AS visit_no FROM r
LEFT JOIN (SELECT crawl_id, count(*) AS used FROM v GROUP BY crawl_id) USING (crawl_id)
WHERE visit_no <= 8 - coalesce(used, 0)""")
def d6(spark, sf):
    visited = table(spark, sf, "visited_pages").distinct()
    return threads.expand_frontier(table(spark, sf, "leads"), visited, 8).drop("found_at")


_D7 = ctes("page_posts").replace("WITH ", "WITH RECURSIVE ", 1) + """,
w AS (SELECT conv_id AS crawl_id, page_url AS url, 1 AS n FROM page_posts WHERE turn = 0
  UNION ALL SELECT w.crawl_id, concat('https://www.threads.net/@u/post/', p.code), n + 1
  FROM w JOIN page_posts p ON p.page_url = w.url WHERE n < 4)
"""


@query("d7_crawl_reach", _D7 + "SELECT w.crawl_id, p.id, p.code, p.text FROM w JOIN page_posts p ON p.page_url = w.url")
def d7(spark, sf):
    pages = table(spark, sf, "page_posts")
    starts = pages.filter("turn = 0").selectExpr("conv_id AS crawl_id", "page_url AS url")
    posts, _ = threads.crawl_reach(starts, pages.drop("conv_id", "turn"), max_pages=4)
    return posts.select("crawl_id", "id", "code", "text")


@query("d7_crawl_reach_pages", _D7 + "SELECT crawl_id, count(*) AS visited_pages, count(*) >= 4 AS budget_hit FROM w GROUP BY crawl_id")
def d7_pages(spark, sf):
    pages = table(spark, sf, "page_posts")
    starts = pages.filter("turn = 0").selectExpr("conv_id AS crawl_id", "page_url AS url")
    return threads.crawl_reach(starts, pages.drop("conv_id", "turn"), max_pages=4)[1]


@query("d7_crawl_reach_whole", _D7.replace("WHERE n < 4", "") + "SELECT w.crawl_id, p.id, p.code, p.text FROM w JOIN page_posts p ON p.page_url = w.url")
def d7_whole(spark, sf):
    """The closure without a page budget."""
    pages = table(spark, sf, "page_posts")
    starts = pages.filter("turn = 0").selectExpr("conv_id AS crawl_id", "page_url AS url")
    return threads.crawl_reach(starts, pages.drop("conv_id", "turn"))[0].select("crawl_id", "id", "code", "text")


@query("d8_escalate", ctes("thread_posts") + """,
fast AS (SELECT * FROM thread_posts WHERE seq < 2),
a AS (SELECT thread_id, bool_or(code = root_code) AND count(*) FILTER (code <> root_code)
  < coalesce(max(CASE WHEN code = root_code THEN reply_count END), 0) AS inc FROM fast GROUP BY thread_id),
sw AS (SELECT thread_id FROM a WHERE inc)
SELECT thread_id, seq, id, 'fast' AS scrape_mode FROM fast ANTI JOIN sw USING (thread_id)
UNION ALL SELECT thread_id, seq, id, 'deep' FROM thread_posts SEMI JOIN sw USING (thread_id)""")
def d8(spark, sf):
    deep = table(spark, sf, "thread_posts")
    return threads.escalate(deep.filter("seq < 2"), deep).select(
        "thread_id", "seq", "id", "scrape_mode")


def thread_inputs(spark, sf):
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "thread_posts").withColumns(
        {"images": one("image"), "videos": one("video"), "downloaded": one("saved")}).drop("image", "video", "saved")


THREADS_SQL = """,
t AS (SELECT thread_id, max(source) AS source, max(root_code) AS root_code,
  max(CASE WHEN code = root_code THEN author END) AS author, max(CASE WHEN code = root_code THEN text END) AS body,
  max(CASE WHEN code = root_code THEN id END) AS post_id, max(CASE WHEN code = root_code THEN likes END) AS likes,
  max(CASE WHEN code = root_code THEN reply_count END) AS replies, bool_or(code = root_code) AS found,
  count(*) FILTER (code <> root_code) AS captured, count(image) AS images, count(video) AS videos, count(saved) AS got,
  coalesce(array_to_string(array_agg(concat_ws('|', id, author, coalesce(text, ''), likes, reply_count) ORDER BY seq)
    FILTER (code <> root_code), chr(10)), '') AS comments,
  coalesce(array_to_string(array_agg(saved ORDER BY seq) FILTER (saved IS NOT NULL), ','), '') AS media_paths
  FROM thread_posts GROUP BY thread_id)
"""


@query("d9_assemble_threads", ctes("thread_posts") + THREADS_SQL + """
SELECT thread_id, source, coalesce(body, '') AS body_text, comments, media_paths, author, root_code AS code, likes,
  replies AS reply_count, captured AS comment_count_captured, got = images + videos AND images + videos > 0 AS media_complete,
  coalesce(replies, 0) AS expected, captured < coalesce(replies, 0) AS incomplete, post_id,
  CASE WHEN images + videos = 0 THEN 'none' WHEN got = 0 THEN 'download_failed' WHEN got < images + videos
    THEN 'partially_downloaded' ELSE 'downloaded' END AS media_label,
  CASE WHEN NOT found THEN 'root not found' END AS reject_reason
FROM t""")
def d9(spark, sf):
    records = threads.assemble_threads(thread_inputs(spark, sf), downloaded=True)
    extra = lambda k: F.try_element_at("meta.extra", F.lit(k)).alias(k)
    return records.select(
        "thread_id", "source", "body_text",
        F.array_join(F.transform("comments", lambda c: F.concat_ws(
            "|", c["id"], c["author"], c["text"], c["likes"].cast("string"), c["reply_count"].cast("string"))), "\n")
        .alias("comments"),
        F.array_join("media_paths", ",").alias("media_paths"),
        "meta.author", "meta.code", "meta.likes", "meta.reply_count", "meta.comment_count_captured",
        "meta.media_complete", "meta.completeness.expected", "meta.completeness.incomplete", extra("post_id"),
        extra("media_label"), "reject_reason")


@query("d10_media_label", ctes("thread_posts") + THREADS_SQL + """
SELECT thread_id, CASE WHEN images + videos = 0 THEN 'none' WHEN got = 0 THEN 'download_failed'
  WHEN got < images + videos THEN 'partially_downloaded' ELSE 'downloaded' END AS media_label,
  got = images + videos AND images + videos > 0 AS media_complete FROM t""")
def d10(spark, sf):
    return threads.media_label(thread_inputs(spark, sf), True)
