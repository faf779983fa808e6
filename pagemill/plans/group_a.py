"""Queries over sources, routing, keys and URLs, with their checking SQL."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from .. import rules
from ..operators import urls
from ..sources import captures
from .sqltext import host, lit, scheme, strip, visible_text
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


@query("a1_load_captures", ctes("raw_captures") + """
SELECT page_id, url,
  CASE WHEN page_id % 4 = 0 AND page_id % 8 <> 0 THEN concat('https://f.example.com/', page_id) ELSE url END AS final_url,
  CASE WHEN page_id % 4 = 0 AND page_id % 3 <> 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 4 = 0 THEN concat('<p>page ', page_id, '</p>') ELSE raw END AS body,
  CASE WHEN page_id % 4 = 0 THEN 'UA' END AS user_agent,
  CASE WHEN page_id % 4 = 0 THEN CAST(page_id AS VARCHAR) END AS cookie_a
FROM raw_captures""")
def a1(spark, sf):
    df = captures.parse_captures(table(spark, sf, "raw_captures"))
    return df.select("page_id", "url", "final_url", "status", "body", "user_agent",
                     F.try_element_at("cookies", F.lit("a")).alias("cookie_a"))


_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^[^/]+(\\.[^./]+)$', 1))"
_KIND = (
    f"CASE WHEN {_EXT} IN ('.m4a','.mp3','.wav','.aac','.ogg') THEN 'audio' "
    f"WHEN {_EXT} IN ('.mp4','.mov','.mkv','.webm') THEN 'video' "
    f"WHEN {_EXT} IN ('.jpg','.jpeg','.png','.webp','.gif','.bmp') THEN 'image' "
    f"WHEN {_EXT} IN ('.txt','.md') THEN 'text' "
    f"WHEN {_EXT} IN ('.pdf','.docx','.pptx','.xls','.xlsx','.csv','.ipynb','.msg','.zip') THEN 'document' "
    "ELSE 'unsupported' END"
)


@query("a2_inventory_files", ctes("media_files") + f""",
k AS (SELECT *, {_EXT} AS ext, {_KIND} AS file_type FROM media_files)
SELECT path AS source, 'local' AS platform, file_type, strlen(text) AS size_bytes,
  CASE WHEN file_type = 'text' THEN regexp_replace(text, '\\r\\n?', chr(10), 'g') END AS body_text,
  CASE WHEN file_type IN ('video','audio','image') THEN path ELSE '' END AS media_paths,
  CASE WHEN file_type = 'document' THEN 'skipped_no_tool' END AS conversion_label,
  CASE WHEN file_type = 'unsupported' THEN concat('unsupported_type:', CASE ext WHEN '' THEN 'none' ELSE ext END) END
    AS reject_reason
FROM k""")
def a2(spark, sf):
    files = table(spark, sf, "media_files").select(
        "path", F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    return captures.describe_files(files).withColumn("media_paths", F.array_join("media_paths", ","))


_HOSTS = {
    "youtube": r"([\w-]+\.)?(youtube\.com|youtu\.be)", "threads": r"(www\.)?(threads\.net|threads\.com)",
    "facebook": r"([\w-]+\.)?(facebook\.com|fb\.watch|fb\.com)", "naver_blog": r"(m\.)?blog\.naver\.com",
    "instagram": r"(www\.)?instagram\.com", "tiktok": r"(www\.|vt\.|vm\.)?tiktok\.com",
}
_PLATFORM = "CASE " + " ".join(
    f"WHEN regexp_matches(s, '^(https?://)?{h}/', 'i') THEN '{p}'" for p, h in _HOSTS.items()
) + " WHEN regexp_matches(s, '^https?://', 'i') THEN 'web' END"


@query("a3_route_urls", ctes("post_urls", "local_paths") + f""",
u AS (SELECT id, url FROM post_urls UNION ALL SELECT page_id + 10000000, url FROM pages),
s AS (SELECT *, {strip("url")} AS s FROM u),
local AS (SELECT path AS p FROM local_paths)
SELECT id, url, CASE WHEN p IS NOT NULL THEN 'local' ELSE {_PLATFORM} END AS platform,
  CASE WHEN p IS NOT NULL THEN NULL WHEN s = '' OR s IS NULL THEN 'empty'
       WHEN ({_PLATFORM}) IS NULL THEN 'unsupported' END AS route_error
FROM s LEFT JOIN (SELECT DISTINCT p FROM local) ON url = p""")
def a3(spark, sf):
    posts = table(spark, sf, "post_urls")
    pages = table(spark, sf, "pages").select((F.col("page_id") + 10000000).alias("id"), "url")
    return urls.route_urls(posts.unionByName(pages), "url", table(spark, sf, "local_paths"))


@query("a4_parse_post_keys", ctes("post_urls") + f""",
u AS (SELECT id, url FROM post_urls UNION ALL SELECT page_id + 10000000, url FROM pages),
s AS (SELECT *, {strip("url")} AS s FROM u),
r AS (SELECT id, url, s, {_PLATFORM} AS platform FROM s),
x AS (SELECT *,
  coalesce(nullif(regexp_extract(s, '^([A-Za-z0-9_-]{{11}})$', 1), ''),
    nullif(regexp_extract(s, '[?&]v=([A-Za-z0-9_-]{{11}})', 1), ''),
    nullif(regexp_extract(s, 'youtu\\.be/([A-Za-z0-9_-]{{11}})', 1), ''),
    nullif(regexp_extract(s, '/(?:live|shorts|embed|v)/([A-Za-z0-9_-]{{11}})', 1), '')) AS yt,
  regexp_extract(s, '/@([A-Za-z0-9_.]+)/post/([A-Za-z0-9_-]+)', 1, 'i') AS ta,
  nullif(regexp_extract(s, '/@([A-Za-z0-9_.]+)/post/([A-Za-z0-9_-]+)', 2, 'i'), '') AS tc,
  nullif(regexp_extract(s, '/(?:p|reel|tv)/([A-Za-z0-9_-]+)', 1, 'i'), '') AS ig,
  nullif(regexp_extract(url, '[?&]blogId=([A-Za-z0-9_-]+)', 1, 'i'), '') AS qb,
  nullif(regexp_extract(url, '[?&]logNo=([0-9]+)', 1, 'i'), '') AS ql,
  nullif(regexp_extract(url, 'blog\\.naver\\.com/([A-Za-z0-9_-]+)', 1, 'i'), '') AS pb,
  nullif(regexp_extract(url, 'blog\\.naver\\.com/[A-Za-z0-9_-]+/([0-9]+)', 1, 'i'), '') AS pl
  FROM r),
y AS (SELECT *, lower(coalesce(pb, '')) IN ('postview','postlist','prologue','guestbook') AS res FROM x),
k AS (SELECT *, CASE platform WHEN 'youtube' THEN yt
    WHEN 'threads' THEN CASE WHEN ta LIKE '%..%' OR ta LIKE '.%' OR ta LIKE '%.' THEN NULL ELSE tc END
    WHEN 'instagram' THEN ig
    WHEN 'naver_blog' THEN coalesce(qb, CASE WHEN NOT res THEN pb END)
    WHEN 'facebook' THEN CASE WHEN regexp_matches(url, '^https?://([\\w-]+\\.)*facebook\\.com/', 'i') THEN url END
    WHEN 'tiktok' THEN s WHEN 'web' THEN s END AS key,
  CASE WHEN platform = 'naver_blog' THEN coalesce(ql, CASE WHEN qb IS NULL AND NOT res THEN pl END) END AS log_no
  FROM y)
SELECT id, url, platform, key, CASE WHEN platform = 'threads' AND key IS NOT NULL THEN ta END AS author,
  CASE WHEN key IS NOT NULL THEN log_no END AS log_no,
  CASE WHEN key IS NULL THEN NULL
    WHEN platform = 'facebook' THEN CASE WHEN regexp_matches(url,
      '/posts/|/permalink\\.php|story_fbid=|/videos/|/watch|/share/|[?&]fbid=|/photo', 'i') THEN 'post' ELSE 'profile' END
    WHEN platform = 'naver_blog' THEN CASE WHEN log_no IS NULL THEN 'blog' ELSE 'post' END
    WHEN platform = 'web' THEN 'page' ELSE 'post' END AS kind,
  CASE WHEN key IS NULL THEN NULL
    WHEN platform = 'youtube' THEN concat('https://www.youtube.com/watch?v=', key)
    WHEN platform = 'threads' THEN concat('https://www.threads.net/@', ta, '/post/', key)
    WHEN platform = 'instagram' THEN concat('https://www.instagram.com/p/', key, '/')
    WHEN platform = 'naver_blog' THEN concat_ws('/', 'https://blog.naver.com', key, log_no)
    ELSE key END AS canonical_url,
  CASE WHEN key IS NOT NULL THEN NULL WHEN platform IS NULL THEN 'no_platform' ELSE 'no_key' END AS key_error
FROM k""")
def a4(spark, sf):
    posts = table(spark, sf, "post_urls")
    pages = table(spark, sf, "pages").select((F.col("page_id") + 10000000).alias("id"), "url")
    routed = urls.route_urls(posts.unionByName(pages)).drop("route_error")
    return urls.parse_post_keys(routed)


_REDDIT = "(h LIKE '%reddit.com%' OR h = 'redd.it')"
_X = "(h IN ('x.com','twitter.com') OR h LIKE '%.x.com' OR h LIKE '%.twitter.com')"


@query("a5_official_routes", ctes("post_urls") + f""",
u AS (SELECT id, url, regexp_replace({host("url")}, '^www\\.', '') AS h,
  rtrim(split_part(url, '?', 1), '/') AS base,
  nullif(regexp_extract(url, '/status(?:es)?/([0-9]+)', 1), '') AS st,
  regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1) AS handle FROM post_urls),
r AS (
  SELECT id, url, 'reddit' AS site, 1 AS priority, 'rss' AS route,
    base || CASE WHEN base LIKE '%/comments/%' THEN '.rss' ELSE '/.rss' END AS route_url FROM u WHERE {_REDDIT}
  UNION ALL SELECT id, url, 'reddit', 2, 'json',
    base || CASE WHEN base LIKE '%/comments/%' THEN '.json' ELSE '/.json' END FROM u WHERE {_REDDIT}
  UNION ALL SELECT id, url, 'x', 1, 'tweet-result',
    'https://cdn.syndication.twimg.com/tweet-result?id=' || st || '&token=a' FROM u WHERE {_X} AND st IS NOT NULL
  UNION ALL SELECT id, url, 'x', 2, 'oembed',
    'https://publish.twitter.com/oembed?url=https://twitter.com/i/status/' || st || '&omit_script=1'
    FROM u WHERE {_X} AND st IS NOT NULL
  UNION ALL SELECT id, url, 'x', 1, 'syndication-timeline',
    'https://syndication.twitter.com/srv/timeline-profile/screen-name/' || handle FROM u
    WHERE {_X} AND st IS NULL AND handle <> '' AND lower(handle) NOT IN
      ('i','search','home','explore','messages','notifications','settings','hashtag')
  UNION ALL SELECT id, url, 'youtube', 1, 'yt-dlp', url FROM u WHERE h LIKE '%youtube.com%' OR h = 'youtu.be')
SELECT * FROM r""")
def a5(spark, sf):
    return urls.official_routes(table(spark, sf, "post_urls"))


@query("a6_expand_url_variants", f"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL
  SELECT -1 - o_orderkey, concat('https://www.shop', o_custkey, '.example.com:8080/o/', o_orderkey, '?a=1#f') FROM orders),
h AS (SELECT *, {host("url")} AS h, nullif(regexp_extract(url, '//[^/?#]*:([0-9]+)(?:[/?#]|$)', 1), '') AS p,
  regexp_extract(url, '^([a-z]+://)', 1) AS head, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS tail FROM u),
v AS (
  SELECT page_id, url, 0 AS variant_no, 'original' AS transform, url AS variant_url FROM h
  UNION ALL SELECT page_id, url, 1, 'mobile_subdomain', head || 'm.' || h[5:] || coalesce(':' || p, '') || tail
    FROM h WHERE h LIKE 'www.%'
  UNION ALL SELECT page_id, url, 2, 'am_prefix', head || 'm.' || h || tail FROM h
    WHERE h <> '' AND h NOT LIKE 'm.%' AND h NOT LIKE 'www.%' AND length(h) - length(replace(h, '.', '')) < 2
  UNION ALL SELECT page_id, url, 3, 'drop_www', head || h[5:] || tail FROM h WHERE h LIKE 'www.%')
SELECT page_id, url, variant_no, transform, variant_url FROM v
QUALIFY row_number() OVER (PARTITION BY page_id, variant_url ORDER BY variant_no) = 1""")
def a6(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    shops = table(spark, sf, "orders").selectExpr(
        "-1 - o_orderkey AS page_id",
        "concat('https://www.shop', o_custkey, '.example.com:8080/o/', o_orderkey, '?a=1#f') AS url")
    return urls.expand_url_variants(pages.unionByName(shops))


@query("a7_redact_urls", f"""
SELECT page_id, split_part(url, '?', 1) AS url,
  split_part(url, '?', 1) || CASE WHEN url LIKE '%?%' THEN {lit(" ?…redacted…")} ELSE '' END AS marked_url,
  replace(html, 'example', '***REDACTED***') AS html
FROM pages""")
def a7(spark, sf):
    pages = table(spark, sf, "pages").withColumn("marked_url", F.col("url"))
    return urls.redact_urls(urls.redact_urls(pages, ["url"], {"html": "example"}), ["marked_url"], marker=True)


def _blocked(ip: str) -> str:
    number = " + ".join(f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    nets = [ipaddress.ip_network(n) for n in rules.BLOCKED_IPV4]
    return "(" + " OR ".join(
        f"({number}) BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets) + ")"


@query("a8_guard_urls", ctes("guard_urls", "resolved") + f""",
g AS (SELECT id, url, {scheme("url")} AS sc, {host("url")} AS h FROM guard_urls),
v AS (SELECT host, min(CASE WHEN {_blocked("ip")} THEN ip END) AS bad FROM resolved GROUP BY host),
j AS (SELECT g.*, v.host, v.bad, regexp_matches(h, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') AS v4 FROM g
  LEFT JOIN v ON g.h = v.host),
r AS (SELECT id, url, CASE WHEN sc NOT IN ('http','https') THEN 'scheme:' || sc
  WHEN h = '' THEN 'no_host'
  WHEN v4 THEN CASE WHEN {_blocked("CASE WHEN v4 THEN h ELSE '8.8.8.8' END")} THEN 'ip_blocked:' || h ELSE 'public_ip' END
  WHEN h = '::1' THEN 'ip_blocked:::1' WHEN h LIKE '%:%' THEN 'public_ip'
  WHEN bad IS NOT NULL THEN 'resolves_internal:' || h || '->' || bad
  WHEN host IS NOT NULL THEN 'public' ELSE 'resolve_failed_allow' END AS reason FROM j)
SELECT id, url, NOT (reason LIKE 'scheme:%' OR reason = 'no_host' OR reason LIKE 'ip_blocked:%'
  OR reason LIKE 'resolves_internal:%') AS is_safe, reason FROM r""")
def a8(spark, sf):
    return urls.guard_urls(
        table(spark, sf, "guard_urls"), "url", table(spark, sf, "resolved").select("host", "ip"))


@query("a9_resolve_redirects", ctes("hop_table", "redirect_starts").replace("WITH ", "WITH RECURSIVE ", 1) + """,
walk AS (
  SELECT id, url AS cur, 0 AS hops, CAST(NULL AS VARCHAR) AS error, 1 AS fetches FROM redirect_starts
  UNION ALL
  SELECT w.id, CASE WHEN h.location LIKE '/%' THEN 'http://h.example.com' || h.location ELSE w.cur END,
    CASE WHEN h.location LIKE '/%' THEN w.hops + 1 ELSE w.hops END,
    CASE WHEN h.location LIKE 'http://127%' THEN 'ssrf_redirect_blocked:ip_blocked:127.0.0.1' END, w.fetches + 1
  FROM walk w JOIN hop_table h ON w.cur = h.url
  WHERE w.error IS NULL AND h.location IS NOT NULL AND h.status IN (301,302,303,307,308) AND w.fetches <= 6),
last AS (SELECT id, max_by(cur, fetches) AS cur, max_by(hops, fetches) AS hops,
  arg_max(coalesce(error, ''), fetches) AS error, max(fetches) AS fetches FROM walk GROUP BY id)
SELECT s.id, s.url, CASE WHEN l.error = '' AND l.fetches <= 6 AND h.url IS NOT NULL THEN l.cur END AS final_url, l.hops,
  CASE WHEN l.error = '' AND l.fetches <= 6 THEN h.status END AS status,
  CASE WHEN l.error <> '' THEN l.error WHEN l.fetches > 6 THEN 'too_many_redirects'
    WHEN h.url IS NULL THEN 'not_captured' END AS error
FROM redirect_starts s JOIN last l USING (id) LEFT JOIN hop_table h ON h.url = l.cur""")
def a9(spark, sf):
    return urls.resolve_redirects(table(spark, sf, "redirect_starts"), table(spark, sf, "hop_table"), max_redirects=5)


@query("a10_batch_by_host", f"""
SELECT page_id AS position, url, coalesce(nullif({host("url")}, ''), 'unknown') AS host,
  rank() OVER (PARTITION BY {host("url")} ORDER BY page_id) AS in_host FROM pages""")
def a10(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("position"), "url")
    batched = urls.batch_by_host(pages)
    from ..functions.ordered import chunk_of, ordered_values

    return ordered_values(batched, ["host"], ["position"], chunk_of("position"), running={"in_host": F.lit(1)})


@query("a11_normalize_lang", f"""
WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN lang || '-' || upper(lang)
    WHEN 2 THEN lang || '_US.UTF-8' WHEN 3 THEN 'Korean_Korea.949' WHEN 4 THEN 'C' END AS locale, lang FROM documents),
t AS (SELECT *, lower(trim(regexp_extract(split_part(trim(locale), '.', 1), '^([^-_]*)', 1))) AS k FROM d)
SELECT doc_id, locale, lang, coalesce(CASE WHEN regexp_matches(k, '^[a-z]{{2,3}}$') THEN k
  WHEN k = 'korean' THEN 'ko' END, lang, 'en') AS lang_code FROM t""")
def a11(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.expr("CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN lang || '-' || upper(lang) "
               "WHEN 2 THEN lang || '_US.UTF-8' WHEN 3 THEN 'Korean_Korea.949' WHEN 4 THEN 'C' END").alias("locale"),
        "lang")
    return urls.normalize_lang(docs, ["locale", "lang"])
