"""Queries over platform normalizers and page-level table work, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import blog, quality, threads, timeline, video
from ..sources import captures
from .sqltext import strip
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


def extra(name: str):
    return F.try_element_at("meta.extra", F.lit(name)).alias(name)


@query("e1_normalize_youtube", ctes("infos") + """
SELECT source, 'youtube' AS platform, coalesce(json_extract_string(info, '$.description'), '') AS body_text,
  json_extract_string(info, '$.title') AS title, json_extract_string(info, '$.id') AS video_id,
  json_extract_string(info, '$.view_count') AS view_count, '["en","ko"]' AS subtitle_langs,
  CASE WHEN contains(info, '"ja"') THEN 'true' ELSE 'false' END AS auto_caption_available,
  CASE WHEN contains(info, '"ja"') THEN '["ja"]' ELSE '[]' END AS auto_caption_langs, '[{"t":1}]' AS chapters,
  CASE json_extract_string(info, '$.view_count') WHEN '0' THEN 'zero_views' ELSE
    CASE WHEN json_extract_string(info, '$.view_count') IS NULL THEN 'unavailable' ELSE 'computed' END END AS engagement_label,
  CASE json_extract_string(info, '$.view_count') WHEN '1' THEN '1.0' WHEN '2' THEN '0.5' WHEN '3' THEN '0.333333' END AS like_rate
FROM infos""")
def e1(spark, sf):
    r = video.normalize_youtube(table(spark, sf, "infos"))
    return r.select("source", "platform", "body_text", "meta.title", extra("video_id"), extra("view_count"),
                    extra("subtitle_langs"), extra("auto_caption_available"), extra("auto_caption_langs"),
                    extra("chapters"), extra("engagement_label"), extra("like_rate"))


@query("e2_engagement", ctes("video_stats") + """
SELECT id, view_count, like_count, comment_count,
  CASE WHEN view_count > 0 THEN round(coalesce(like_count, 0)::DOUBLE / view_count, 6) END AS like_rate,
  CASE WHEN view_count > 0 THEN round(comment_count::DOUBLE / view_count, 6) END AS comment_rate,
  CASE WHEN view_count > 0 THEN 'computed' WHEN view_count = 0 THEN 'zero_views' ELSE 'unavailable' END AS engagement_label
FROM video_stats""")
def e2(spark, sf):
    return video.engagement(table(spark, sf, "video_stats"))


@query("e3_video_chat_labels", ctes("downloads_state") + """
SELECT id, CASE WHEN NOT with_video THEN 'none' WHEN NOT ok OR NOT got_video THEN 'download_failed'
  WHEN clipped THEN 'clipped' WHEN from_start AND live_status IN ('is_live','was_live','post_live')
  THEN 'downloaded_from_start' ELSE 'downloaded' END AS video_label,
  CASE WHEN NOT with_chat THEN 'none' WHEN chat_status = 'failed' THEN 'download_failed'
  WHEN chat_path IS NOT NULL AND chat_count > 0 THEN CASE WHEN live_status = 'is_live' THEN 'live_captured'
    ELSE 'replay_full' END ELSE 'disabled' END AS chat_label FROM downloads_state""")
def e3(spark, sf):
    return video.video_chat_labels(table(spark, sf, "downloads_state")).select("id", "video_label", "chat_label")


@query("e4_count_chat", f"""
WITH l AS (SELECT concat('/chat/', conv_id) AS path, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT path, count(*) FILTER ({strip("line")} <> '') AS chat_message_count FROM l GROUP BY path
UNION ALL SELECT DISTINCT concat('/missing/', conv_id), 0 FROM conversations""")
def e4(spark, sf):
    turns = table(spark, sf, "conversations")
    lines = turns.select(
        F.concat(F.lit("/chat/"), "conv_id").alias("path"), F.explode_outer(F.split("text", "\n")).alias("line"))
    files = turns.select(F.explode(F.array(
        F.concat(F.lit("/chat/"), "conv_id"), F.concat(F.lit("/missing/"), "conv_id"))).alias("path"))
    return captures.count_chat(lines, files)


@query("e5_clean_transcript", ctes("segments") + f""",
l AS (SELECT video_id, seq, {strip("regexp_replace(replace(text, chr(10), ' '), '[ \\t]+', ' ', 'g')")} AS line FROM segments),
n AS (SELECT * FROM l WHERE line <> ''),
p AS (SELECT *, lag(line) OVER (PARTITION BY video_id ORDER BY seq) AS before FROM n),
t AS (SELECT video_id, string_agg(line, chr(10) ORDER BY seq) AS transcript FROM p
  WHERE before IS NULL OR before <> line GROUP BY video_id)
SELECT v.video_id, transcript, CASE WHEN transcript IS NULL THEN 'unavailable' ELSE 'fetched' END AS transcript_label
FROM (SELECT DISTINCT video_id FROM segments) v LEFT JOIN t USING (video_id)""")
def e5(spark, sf):
    return video.clean_transcript(table(spark, sf, "segments")).drop("part_no")


@query("e6_top_comments", ctes("video_comments") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rk FROM video_comments),
b AS (SELECT video_id, min(CASE WHEN is_error AND rk <= 4 THEN rk END) AS broke FROM r GROUP BY video_id)
SELECT video_id, coalesce(array_to_string(array_agg(concat_ws('|', author, text, votes) ORDER BY rk)
    FILTER (rk <= 3 AND NOT is_error AND (broke IS NULL OR rk < broke)), chr(10)), '') AS comments,
  CASE WHEN max(broke) IS NULL THEN 'fetched' ELSE 'fetch_failed' END AS comments_label
FROM r JOIN b USING (video_id) GROUP BY video_id""")
def e6(spark, sf):
    top = video.top_comments(table(spark, sf, "video_comments"), 3)
    return top.withColumn("comments", F.array_join(F.transform("comments", lambda c: F.concat_ws(
        "|", c["author"], c["text"], c["likes"].cast("string"))), "\n"))


@query("e7_collect_outputs", ctes("output_files") + """
SELECT video_id, CASE WHEN regexp_matches(lower(path), '\\.(vtt|srt|ass|json3|srv1|srv2|srv3)$') THEN 'subtitle'
  ELSE 'video' END AS kind, path FROM output_files
WHERE NOT regexp_matches(lower(path), '\\.(part|ytdl|temp)$') AND lower(path) NOT LIKE '%.live_chat.json'""")
def e7(spark, sf):
    return video.collect_outputs(table(spark, sf, "output_files"))


@query("e1_assemble_videos", f"""
WITH i AS (SELECT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS video_id FROM ({ctes("infos")} SELECT * FROM infos)),
f AS (SELECT video_id, string_agg(path, ',' ORDER BY path) FILTER (kind = 'video') AS videos, count(*) FILTER (kind = 'subtitle') AS subtitles
  FROM ({ORACLES["e7_collect_outputs"]}) GROUP BY video_id),
t AS ({ORACLES["e5_clean_transcript"]}),
c AS ({ORACLES["e6_top_comments"]})
SELECT i.source, coalesce(videos, '') AS media_paths, CAST(coalesce(subtitles, 0) AS BIGINT) AS subtitles, transcript,
  coalesce(transcript_label, 'none') AS transcript_label, coalesce(comments, '') AS comments, coalesce(comments_label, 'none') AS comments_label,
  coalesce(video_id % 3, 0) AS chat_messages
FROM i LEFT JOIN f USING (video_id) LEFT JOIN t USING (video_id) LEFT JOIN c USING (video_id)""")
def e1_assembled(spark, sf):
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("long")
    infos = table(spark, sf, "infos").withColumn("video_id", number)
    whole = video.assemble_videos(
        infos, video.collect_outputs(table(spark, sf, "output_files")), video.clean_transcript(table(spark, sf, "segments"), 2),
        video.top_comments(table(spark, sf, "video_comments"), 3),
        infos.select("video_id", (F.col("video_id") % 3).alias("chat_message_count")))
    r = video.normalize_youtube(whole)
    return r.select(
        "source", F.array_join("media_paths", ",").alias("media_paths"),
        F.size(F.from_json(F.try_element_at("meta.extra", F.lit("subtitle_paths")), "array<string>")).cast("long").alias("subtitles"),
        "transcript", "meta.transcript_label", F.array_join(F.transform("comments", lambda c: F.concat_ws(
            "|", c["author"], c["text"], c["likes"].cast("string"))), "\n").alias("comments"), extra("comments_label"),
        extra("chat_message_count").cast("long").alias("chat_messages"))


@query("e8_normalize_tiktok", ctes("dumps") + """
SELECT source, CASE WHEN dump LIKE '[[2%' THEN json_extract_string(dump, '$[1][1].desc') ELSE '' END AS body_text,
  CASE WHEN dump LIKE '[[2%' THEN 'nick' WHEN dump LIKE '[[1],%' THEN json_extract_string(dump, '$[1][1].author.uniqueId') END
    AS author,
  CASE WHEN dump LIKE '[[2%' OR dump LIKE '[[1],%' THEN json_extract_string(dump, '$[1][1].id') END AS video_id,
  CASE WHEN dump LIKE '[[2%' THEN 'true' ELSE 'false' END AS author_verified,
  CASE WHEN dump LIKE '[[2%' THEN '5' ELSE '0' END AS digg_count,
  CASE WHEN dump LIKE '[[2%' THEN '2023-11-14T22:13:20Z' END AS created_at_utc,
  CASE WHEN downloaded THEN 'download_failed' ELSE 'none' END AS media_label,
  CASE WHEN NOT (dump LIKE '[[2%' OR dump LIKE '[[1],%') THEN 'no payload object' END AS reject_reason
FROM dumps""")
def e8(spark, sf):
    r = video.normalize_tiktok(table(spark, sf, "dumps"))
    return r.select("source", "body_text", "meta.author", extra("video_id"), extra("author_verified"),
                    extra("digg_count"), extra("created_at_utc"), extra("media_label"), "reject_reason")


@query("e9_normalize_instagram", ctes("photo_posts", "photo_comments") + """,
c AS (SELECT shortcode, count(*) AS n, array_to_string(array_agg(concat_ws('|', id, author, text, likes) ORDER BY seq), chr(10)) AS cs
  FROM (SELECT DISTINCT ON (shortcode, seq) * FROM photo_comments ORDER BY shortcode, seq, id, author, text, likes) GROUP BY shortcode),
p AS (SELECT *, CASE WHEN comments_error IS NULL THEN 'not_requested' WHEN comments_error = 'ok' THEN 'collected'
  WHEN comments_error = 'login_required' THEN 'login_required' ELSE 'fetch_failed' END AS label FROM photo_posts)
SELECT source, coalesce(caption, '') AS body_text, owner AS author, shortcode AS code, likes,
  CASE WHEN label = 'collected' AND access_error IS NULL THEN coalesce(n, 0) ELSE 0 END AS comment_count_captured,
  CASE WHEN label = 'collected' AND access_error IS NULL THEN coalesce(cs, '') ELSE '' END AS comments, label AS comments_label,
  CASE WHEN access_error IS NULL THEN 'ok' ELSE 'anonymous_blocked' END AS ig_access_label,
  CASE WHEN access_error IS NOT NULL THEN 'anonymous_blocked' END AS reject_reason
FROM p LEFT JOIN c USING (shortcode)""")
def e9(spark, sf):
    # A comment is known by post and number; of repeats one stays.
    comments = table(spark, sf, "photo_comments").groupBy("shortcode", "seq").agg(
        F.min(F.struct("id", "author", "text", "likes", "created_at")).alias("c")).select("shortcode", "seq", "c.*")
    r = timeline.normalize_instagram(table(spark, sf, "photo_posts"), comments)
    return r.select(
        "source", "body_text", "meta.author", extra("shortcode").alias("code"), "meta.likes",
        "meta.comment_count_captured",
        F.array_join(F.transform("comments", lambda c: F.concat_ws(
            "|", c["id"], c["author"], c["text"], c["likes"].cast("string"))), "\n").alias("comments"),
        extra("comments_label"), extra("ig_access_label"), "reject_reason")


@query("e9_instagram_parts", ctes("photo_posts", "photo_comments") + """,
c AS (SELECT shortcode, count(DISTINCT seq) AS n FROM photo_comments GROUP BY shortcode),
p AS (SELECT source, coalesce(caption, '') AS caption,
  CASE WHEN comments_error = 'ok' AND access_error IS NULL THEN coalesce(n, 0) ELSE 0 END AS n FROM photo_posts LEFT JOIN c USING (shortcode)),
k AS (SELECT *, CAST(greatest(1, ceil(n / 2)) AS INT) AS part_count FROM p),
i AS (SELECT *, unnest(range(part_count)) AS i FROM k)
SELECT source, CAST(i AS INT) AS part_no, part_count, CASE WHEN i = 0 THEN caption ELSE '' END AS body_text,
  CAST(least(2, n - 2 * i) AS INT) AS comments, n AS captured FROM i""")
def e9_parts(spark, sf):
    comments = table(spark, sf, "photo_comments").groupBy("shortcode", "seq").agg(
        F.min(F.struct("id", "author", "text", "likes", "created_at")).alias("c")).select("shortcode", "seq", "c.*")
    r = timeline.normalize_instagram(table(spark, sf, "photo_posts"), comments, part_rows=2)
    return r.select("source", "part_no", "part_count", "body_text", F.size("comments").alias("comments"),
                    F.col("meta.comment_count_captured").alias("captured"))


@query("e10_concat_list_pages", ctes("list_pages") + """,
s AS (SELECT blog_id, page, CASE WHEN status = 200 AND body LIKE '{"result":{%'
  THEN json_array_length(body, '$.result.items') ELSE 0 END AS n FROM list_pages),
f AS (SELECT blog_id, min(CASE WHEN n = 0 THEN page END) AS bad, min(CASE WHEN n < 30 THEN page END) AS short FROM s GROUP BY blog_id),
k AS (SELECT blog_id, page, n, coalesce(sum(n) OVER (PARTITION BY blog_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS before FROM s JOIN f USING (blog_id)
  WHERE page < coalesce(bad, 1000000) AND page <= coalesce(short, 1000000)),
i AS (SELECT blog_id, before + unnest(range(n::BIGINT)) AS position FROM k)
SELECT blog_id, position::BIGINT AS position, 1 AS item FROM i WHERE position < 70""")
def e10(spark, sf):
    items = blog.concat_list_pages(table(spark, sf, "list_pages"), 30, 70)
    return items.withColumn("item", F.try_variant_get("item", "$.n", "int"))


@query("e11_join_listing", ctes("blog_posts", "listing") + """
SELECT p.blog_id, p.log_no, og_title, coalesce(nullif(og_title, ''), nullif(title_with_inspect, ''), l.title) AS title,
  add_date, category, comment_count, read_count, coalesce(nullif(sympathy_count, 0), like_count) AS like_count,
  concat('https://blog.naver.com/', p.blog_id, '/', p.log_no) AS url,
  CASE WHEN NOT regexp_full_match(p.log_no, '[0-9]{1,20}') THEN 'invalid log_no' END AS reject_reason
FROM blog_posts p LEFT JOIN listing l ON p.blog_id = l.blog_id AND p.log_no = l.log_no""")
def e11(spark, sf):
    return blog.join_listing(table(spark, sf, "blog_posts"), table(spark, sf, "listing"))


@query("e12_normalize_naver", ctes("blog_posts", "listing") + """
SELECT concat('https://blog.naver.com/', p.blog_id, '/', p.log_no) AS source, '' AS body_text,
  coalesce(nullif(og_title, ''), nullif(title_with_inspect, ''), l.title) AS title, p.log_no,
  CAST(coalesce(nullif(sympathy_count, 0), like_count) AS VARCHAR) AS like_count, '2' AS image_count, '0' AS video_count,
  'none' AS image_size_label, 'false' AS body_truncated
FROM blog_posts p LEFT JOIN listing l ON p.blog_id = l.blog_id AND p.log_no = l.log_no""")
def e12(spark, sf):
    posts = e11(spark, sf).withColumns({
        "source": F.col("url"), "body_text": F.lit(None).cast("string"),
        "image_urls": F.array(F.lit("a"), F.col("log_no")), "video_urls": schema.no_paths()})
    return blog.normalize_naver(posts).select(
        "source", "body_text", "meta.title", extra("log_no"), extra("like_count"), extra("image_count"),
        extra("video_count"), extra("image_size_label"), extra("body_truncated"))


# Answers for a third of the images each: the original, a large variant, or only errors.
_ANSWERS = """
SELECT concat('https://blogfiles.pstatic.net/i', p_partkey, '.jpg') AS url,
  CASE WHEN p_partkey % 3 = 0 THEN 200 ELSE 404 END AS status, p_size * 100 AS bytes FROM part
UNION ALL SELECT concat('https://blogfiles.pstatic.net/i', p_partkey, '.jpg?type=w3840'),
  CASE WHEN p_partkey % 3 = 1 THEN 200 ELSE 403 END, 9000 FROM part
UNION ALL SELECT concat('https://postfiles.pstatic.net/i', p_partkey, '.jpg?type=w966'),
  CASE WHEN p_partkey % 2 = 0 THEN 200 ELSE -1 END, p_size * 100 FROM part
UNION ALL SELECT concat('https://other.pstatic.net/i', p_partkey, '.jpg?type=w966'), 200, p_size * 200 FROM part
"""


@query("e13_pick_image_variant", ctes("image_urls") + f""",
a AS ({_ANSWERS}),
p AS MATERIALIZED (SELECT DISTINCT image_id, regexp_extract(url, '^https://([a-z]+)', 1) AS h, split_part(url, '?', 1) AS base FROM image_urls),
c AS MATERIALIZED (SELECT image_id, 1 AS pr, 'original' AS label, base AS candidate FROM p WHERE h = 'blogfiles'
  UNION ALL SELECT image_id, 2, 'original_w3840', base || '?type=w3840' FROM p WHERE h = 'blogfiles'
  UNION ALL SELECT image_id, 1, 'w966_ceiling', base || '?type=w966' FROM p WHERE h IN ('postfiles','blogthumb','mblogthumb')
  UNION ALL SELECT image_id, 1, 'thumbnail_fallback', base || '?type=w966' FROM p
    WHERE h NOT IN ('blogfiles','postfiles','blogthumb','mblogthumb')),
j AS MATERIALIZED (SELECT c.*, status IN (-1,403,408,429,500,502,503,504) AS err, status = 200 AND bytes >= 1500 AS ok
  FROM c LEFT JOIN a ON a.url = c.candidate)
SELECT image_id, coalesce(arg_min(CASE WHEN ok THEN label END, CASE WHEN ok THEN pr END),
    CASE WHEN coalesce(bool_or(err), false) THEN 'failed:error' ELSE 'failed:notfound' END) AS label,
  arg_min(CASE WHEN ok THEN candidate END, CASE WHEN ok THEN pr END) AS used_url
FROM j GROUP BY image_id""")
def e13(spark, sf):
    answers = spark.sql(_ANSWERS.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return blog.pick_image_variant(table(spark, sf, "image_urls"), answers, "image_id")


@query("e14_best_size_label", ctes("size_labels") + """,
r AS (SELECT *, CASE label WHEN 'original' THEN 3 WHEN 'original_w3840' THEN 3 WHEN 'w966_ceiling' THEN 2
  WHEN 'thumbnail_fallback' THEN 1 ELSE 0 END AS rk FROM size_labels WHERE label IS NOT NULL),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY rk DESC, position, label DESC) = 1)
SELECT p.post_id, coalesce(b.label, 'none') AS image_size_label
FROM (SELECT DISTINCT post_id FROM size_labels) p LEFT JOIN b USING (post_id)""")
def e14(spark, sf):
    return blog.best_size_label(table(spark, sf, "size_labels"))


@query("e15_parse_counts", ctes("counted_texts") + """
SELECT doc_id, TRY_CAST(replace(nullif(regexp_extract(text, '(?:좋아요|Likes?)[^0-9]{0,8}([0-9][0-9,]*)', 1), ''), ',', '') AS BIGINT) AS likes,
  TRY_CAST(replace(nullif(regexp_extract(text, '(?:댓글|Comments?)[^0-9]{0,8}([0-9][0-9,]*)', 1), ''), ',', '') AS BIGINT)
    AS comment_count FROM counted_texts""")
def e15(spark, sf):
    return timeline.parse_counts(table(spark, sf, "counted_texts")).drop("text")


@query("e16_dedup_timeline", ctes("articles") + """,
k AS (SELECT *, CASE WHEN permalink IS NOT NULL THEN split_part(permalink, '?', 1)
  WHEN text <> '' THEN md5(text) || '|1' END AS post_key FROM articles)
SELECT profile, scroll, pos, post_key FROM k WHERE post_key IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY profile, post_key ORDER BY scroll, pos) = 1""")
def e16(spark, sf):
    articles = table(spark, sf, "articles").withColumn("images", F.array(F.lit("i")))
    return timeline.dedup_timeline(articles).select("profile", "scroll", "pos", "post_key")


@query("e17_dedup_media_across_posts", ctes("timeline_media") + """,
t AS (SELECT DISTINCT ON (profile, post_seq) * FROM timeline_media ORDER BY profile, post_seq, i1, i2, v1),
m AS (SELECT profile, post_seq, 'image' AS kind, 0 AS pos, i1 AS url FROM t
  UNION ALL SELECT profile, post_seq, 'image', 1, i2 FROM t UNION ALL SELECT profile, post_seq, 'video', 0, v1 FROM t
  UNION ALL SELECT profile, post_seq, 'video', 1, v1 FROM t),
f AS (SELECT *, min(post_seq) OVER (PARTITION BY profile, kind, split_part(url, '?', 1)) AS fp,
  row_number() OVER (PARTITION BY profile, kind, split_part(url, '?', 1) ORDER BY post_seq, pos) AS rn FROM m),
g AS (SELECT profile, post_seq, string_agg(url, ' ' ORDER BY pos) FILTER (kind = 'image' AND rn = 1) AS i,
  string_agg(url, ' ' ORDER BY pos) FILTER (kind = 'video') AS v FROM f WHERE fp = post_seq GROUP BY ALL)
SELECT t.profile, t.post_seq, concat(i1, ' ', i2) AS image_urls, coalesce(i, '') AS images_to_fetch, coalesce(v, '') AS video_urls
FROM t LEFT JOIN g USING (profile, post_seq)""")
def e17(spark, sf):
    # Texts are compared by sorting: once, behind the shuffle.
    one = table(spark, sf, "timeline_media").repartition("profile", "post_seq").groupBy("profile", "post_seq").agg(
        F.min(F.struct("i1", "i2", "v1")).alias("m"))
    posts = one.select("profile", "post_seq", F.array("m.i1", "m.i2").alias("image_urls"),
                       F.array("m.v1", "m.v1").alias("video_urls"))
    done = timeline.dedup_media_across_posts(posts)
    return done.select("profile", "post_seq", *[
        F.array_join(c, " ").alias(c) for c in ("image_urls", "images_to_fetch", "video_urls")])


@query("e18_focus_scope", ctes("page_articles") + """,
o AS (SELECT *, CASE WHEN regexp_extract(page_url, 'facebook\\.com/([^/?#]+)/(?:posts|videos)/', 1) NOT IN ('share', '')
  THEN regexp_extract(page_url, 'facebook\\.com/([^/?#]+)/(?:posts|videos)/', 1)
  ELSE nullif(regexp_extract(page_url, '[?&]id=([0-9]+)', 1), '') END AS owner FROM page_articles),
h AS (SELECT *, coalesce(contains(author_href, '/' || owner) OR contains(author_href, 'id=' || owner), false) AS hit FROM o),
f AS (SELECT *, min(CASE WHEN hit THEN pos END) OVER (PARTITION BY page_url) AS focus FROM h)
SELECT page_url, pos, author_href, focus IS NOT NULL AS matched FROM f WHERE focus IS NULL OR pos = focus""")
def e18(spark, sf):
    return timeline.focus_scope(table(spark, sf, "page_articles"))


@query("e19_comment_candidates", ctes("comment_articles") + """,
b AS (SELECT *, min(CASE WHEN contains(text, caption) THEN pos END) OVER (PARTITION BY post_id) AS body FROM comment_articles)
SELECT post_id, pos - coalesce(body, 0) - 1 AS index, text AS raw_text, false AS text_cut, body IS NOT NULL AS body_matched,
  caption IS NOT NULL AS caption_given FROM b
WHERE pos > coalesce(body, 0) AND trim(text) <> '' AND NOT regexp_matches(text, 'loading', 'i') AND aria_label IS NULL""")
def e19(spark, sf):
    return timeline.comment_candidates(table(spark, sf, "comment_articles"))


@query("e20_parse_comments", """
SELECT conv_id, turn, role AS author, CASE turn % 6 WHEN 0 THEN concat('hello ', conv_id) WHEN 1 THEN '50000'
  WHEN 2 THEN concat('ok', chr(10), '7') WHEN 3 THEN '' WHEN 4 THEN concat('x', chr(10), '9', chr(10), '8') ELSE 'plain' END AS text,
  CASE turn % 6 WHEN 0 THEN 1000 + turn WHEN 2 THEN 3 END AS likes, turn % 6 = 3 AS parse_failed FROM conversations""")
def e20(spark, sf):
    return timeline.parse_comments(table(spark, sf, "raw_comments")).drop("raw_text")


@query("e21_comments_label", ctes("comment_stats") + """
SELECT id, CASE WHEN NOT requested THEN 'not_collected' WHEN comment_count = 0 THEN CASE WHEN raw_count > 0
  THEN 'fetch_failed' ELSE 'none' END
  WHEN expand_hit_cap OR expand_interrupted OR parse_fail > 0 OR (caption_given AND NOT body_matched) THEN 'partial'
  ELSE 'collected' END AS comments_label FROM comment_stats""")
def e21(spark, sf):
    return timeline.comments_label(table(spark, sf, "comment_stats")).select("id", "comments_label")


# Re-visits of a base post: not every post was re-visited, and a re-visit may have found nothing.
def _revisits(spark, sf):
    base = table(spark, sf, "base_posts").withColumns({
        "image_urls": F.array(F.concat(F.lit("b"), "likes")), "video_urls": F.array(F.lit("bv")),
        "local_images": schema.no_paths(), "image_label": F.lit("article_cdn")})
    parts = table(spark, sf, "orders").withColumn(
        "permalink", F.concat(F.lit("https://www.facebook.com/u/posts/"), "o_orderkey"))
    img = parts.select(
        "permalink", F.expr("CASE WHEN o_custkey % 2 = 0 THEN '' ELSE concat('full ', o_custkey) END").alias("text"),
        F.expr("CASE WHEN o_custkey % 3 = 0 THEN array() ELSE array('i1', 'i2') END").alias("image_urls"),
        F.array(F.lit("/l.jpg")).alias("local_images"), F.lit("fullsize_viewer").alias("fullsize_label"))
    vid = parts.select("permalink", F.expr("CASE WHEN o_custkey % 4 = 0 THEN array('v') ELSE array() END").alias(
        "video_urls"), F.array(F.lit("/l.mp4")).alias("local_videos"), F.lit("dom_scan").alias("video_label"))
    cmt = parts.select("permalink", F.array(schema.comment(id=F.lit("1"), author=F.col("o_orderstatus"))).alias(
        "comments"), F.lit("partial").alias("comments_label"))
    return base, img, vid, cmt


_MERGED = ctes("base_posts") + """,
m AS (SELECT b.permalink, coalesce(nullif(CASE WHEN likes % 2 = 0 THEN '' ELSE concat('full ', likes) END, ''), text, '') AS text,
  CASE WHEN likes % 3 = 0 THEN concat('b', likes) ELSE 'i1,i2' END AS image_urls,
  CASE WHEN likes % 4 = 0 THEN 'v' ELSE 'bv' END AS video_urls, likes, comment_count FROM base_posts b)
"""


@query("e22_merge_enriched", _MERGED + """
SELECT permalink, text, image_urls, '/l.jpg' AS local_images, 'fullsize_viewer' AS fullsize_label, video_urls,
  '/l.mp4' AS local_videos, 'dom_scan' AS video_label, likes, comment_count, 1 AS n_comments, 'partial' AS comments_label FROM m""")
def e22(spark, sf):
    merged = timeline.merge_enriched(*_revisits(spark, sf))
    lists = {c: F.array_join(c, ",") for c in ("image_urls", "local_images", "video_urls", "local_videos")}
    return merged.withColumns(lists).withColumn("n_comments", F.size("comments")).drop("comments", "comments_requested")


_IMAGES = ctes("viewer_images") + """,
v AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY pos) AS rn FROM viewer_images WHERE side = 0),
u AS (SELECT post_id, 1 AS priority, pos, url FROM v UNION ALL
  SELECT post_id, 2, pos, url FROM viewer_images WHERE side <> 0),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY post_id, split_part(url, '?', 1) ORDER BY priority, pos, url) = 1),
d AS (SELECT url, max(CASE WHEN status = 'fetched' THEN 1 ELSE 0 END) AS grown FROM viewer_images GROUP BY url),
g AS (SELECT k.*, min(priority) OVER (PARTITION BY post_id) AS best, max(coalesce(grown, 0)) OVER (PARTITION BY post_id) AS up
  FROM k LEFT JOIN d USING (url))
"""


@query("e23_select_images", _IMAGES + """
SELECT post_id, priority, pos, url, CASE WHEN best = 1 THEN 'fullsize_viewer' WHEN up = 1 THEN 'largest_cdn'
  ELSE 'article_thumbnail' END AS fullsize_label FROM g""")
def e23(spark, sf):
    seen = table(spark, sf, "viewer_images")
    return timeline.select_images(seen.filter("side = 0"), seen.filter("side <> 0"), seen.select("url", "status"))


@query("e24_select_videos", ctes("viewer_images") + """,
u AS (SELECT post_id, CASE WHEN side = 1 THEN 1 ELSE 2 END AS priority, pos, video_url AS url,
  nullif(regexp_extract(video_url, '/([A-Za-z0-9_-]{20,})\\.(?:mp4|m4s)', 1), '') AS video_id FROM viewer_images),
k AS (SELECT * FROM u WHERE video_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY post_id, video_id ORDER BY priority, pos, url) = 1)
SELECT post_id, video_id, priority, pos, url, CASE WHEN min(priority) OVER (PARTITION BY post_id) = 1
  THEN 'network_capture' ELSE 'dom_scan' END AS video_label FROM k""")
def e24(spark, sf):
    seen = table(spark, sf, "viewer_images").drop("url").withColumnRenamed("video_url", "url")
    return timeline.select_videos(seen.filter("side = 1"), seen.filter("side <> 1"))


@query("e25_upgrade_media", ctes("offers", "held_files") + """,
o AS (SELECT *, 'fb_' || md5(split_part(url, '?', 1))[1:12] || '.png' AS file_key, contains(url, 'fbcdn') AS allowed,
  status = 200 AND bytes BETWEEN 200 AND 52428800 AND contains(url, 'fbcdn') AS good FROM offers),
b AS (SELECT file_key, max(CASE WHEN good THEN area END) AS best, bool_or(status IS NOT NULL AND allowed) AS answered,
  bool_or(allowed) AS allowed FROM o GROUP BY file_key),
u AS (SELECT file_key, url AS used_url FROM o WHERE good
  QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY area DESC, seq, url DESC) = 1),
h AS (SELECT 'fb_' || md5(base)[1:12] || '.png' AS file_key, max(CASE WHEN bytes > 200 THEN area END) AS have FROM held_files GROUP BY 1),
j AS (SELECT coalesce(b.file_key, h.file_key) AS file_key, coalesce(have, 0) AS have, best, answered, allowed
  FROM h FULL JOIN b ON h.file_key = b.file_key),
a AS (SELECT *, CASE WHEN allowed IS NULL THEN 'kept_existing' WHEN NOT allowed THEN 'skip_host' WHEN have >= 1080000 THEN 'cached'
  WHEN best IS NULL THEN CASE WHEN have > 0 THEN 'kept_existing' WHEN answered THEN 'all_fail' ELSE 'req_err' END
  WHEN have > 0 AND best <= have THEN 'kept_existing' WHEN have > 0 THEN 'upgraded' ELSE 'fetched' END AS action FROM j)
SELECT a.file_key, action, CASE WHEN action IN ('upgraded','fetched') THEN used_url END AS used_url,
  CASE WHEN action IN ('upgraded','fetched') THEN best ELSE have END::BIGINT AS area FROM a LEFT JOIN u USING (file_key)""")
def e25(spark, sf):
    held = table(spark, sf, "held_files").withColumn("file_key", timeline.file_key(F.col("base")))
    return timeline.upgrade_media(held, table(spark, sf, "offers"))


@query("e26_normalize_facebook", _MERGED + """
SELECT permalink AS source, text AS body_text, 1 AS comment_count_captured, likes, '/l.jpg,/l.mp4' AS media_paths,
  CAST(length(image_urls) - length(replace(image_urls, ',', '')) + 1 AS VARCHAR) AS image_count,
  CAST(comment_count AS VARCHAR) AS comment_count, 'partial' AS comments_label FROM m""")
def e26(spark, sf):
    r = timeline.normalize_facebook(timeline.merge_enriched(*_revisits(spark, sf)))
    return r.select("source", "body_text", "meta.comment_count_captured", "meta.likes",
                    F.array_join("media_paths", ",").alias("media_paths"), extra("image_count"),
                    extra("comment_count"), extra("comments_label"))


def documents(spark, sf):
    """Records of every platform in one table."""
    from .group_d import thread_inputs

    pages = table(spark, sf, "pages").withColumn("status", F.lit(200))
    checked = quality.validate_pages(pages, body="html", headers=None, cookies=None)
    web = quality.normalize_web(quality.merge_renderings(checked, None))
    posts = threads.assemble_threads(thread_inputs(spark, sf))
    videos = video.normalize_youtube(table(spark, sf, "infos"))
    clips = video.normalize_tiktok(table(spark, sf, "dumps"))
    photos = timeline.normalize_instagram(table(spark, sf, "photo_posts"))
    entries = blog.normalize_naver(e11(spark, sf).withColumns({
        "source": F.col("url"), "body_text": F.col("title"), "image_urls": schema.no_paths(),
        "video_urls": schema.no_paths()}))
    cards = timeline.normalize_facebook(timeline.merge_enriched(_revisits(spark, sf)[0]))
    files = table(spark, sf, "media_files").select(
        "path", F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    local = captures.normalize_local(captures.describe_files(files))
    return timeline.union_documents(web, posts, videos, clips, photos, entries, cards, local)


@query("e27_union_documents", ctes("infos", "dumps", "photo_posts", "blog_posts", "base_posts", "media_files") + """
SELECT 'web' AS platform, count(*) AS records, 0 AS rejected FROM pages
UNION ALL SELECT 'threads', count(DISTINCT conv_id), (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 4 = 3) FROM conversations
UNION ALL SELECT 'youtube', count(*), 0 FROM infos
UNION ALL SELECT 'tiktok', count(*), count(*) FILTER (NOT (dump LIKE '[[2%' OR dump LIKE '[[1],%')) FROM dumps
UNION ALL SELECT 'instagram', count(*), count(access_error) FROM photo_posts
UNION ALL SELECT 'naver_blog', count(*), 0 FROM blog_posts
UNION ALL SELECT 'local', count(*), count(*) FILTER (doc_id % 10 IN (6, 7)) FROM media_files
UNION ALL SELECT 'facebook', count(*), 0 FROM base_posts""")
def e27(spark, sf):
    return documents(spark, sf).groupBy("platform").agg(
        F.count("*").alias("records"), F.count("reject_reason").alias("rejected"))
