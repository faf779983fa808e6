"""Driver tables and the inputs derived from them.

A derived input is one base table and a list of expressions that Spark and the checking engine both read, so
the two sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(o_orderkey AS STRING)"
_C = "CAST(o_custkey AS STRING)"

POST_URL = f"""CASE o_orderkey % 16
  WHEN 0 THEN concat('https://www.youtube.com/watch?x=1&v=', lpad({_K}, 11, 'A'))
  WHEN 1 THEN concat('  https://youtu.be/', lpad({_K}, 11, 'b'), '?t=3 ')
  WHEN 2 THEN concat('https://www.threads.net/@user.', {_C}, '/post/C', {_K}, '?igsh=1')
  WHEN 3 THEN concat('https://threads.com/@.bad', {_C}, '/post/x', {_K})
  WHEN 4 THEN concat('https://www.instagram.com/reel/I', {_K}, '/')
  WHEN 5 THEN concat('https://blog.naver.com/blog', {_C}, '/', {_K})
  WHEN 6 THEN concat('https://m.blog.naver.com/PostView.naver?blogId=b', {_C}, '&logNo=', {_K})
  WHEN 7 THEN concat('https://vt.tiktok.com/', {_K})
  WHEN 8 THEN concat('https://www.facebook.com/user', {_C}, '/posts/', {_K}, '?x=1')
  WHEN 9 THEN concat('https://m.facebook.com/page.', {_C})
  WHEN 10 THEN concat('https://www.reddit.com/r/sub', {_C}, '/comments/', {_K}, '/?q=1')
  WHEN 11 THEN concat('not a url ', {_K})
  WHEN 12 THEN concat('https://x.com/user', {_C}, '/status/', {_K})
  WHEN 13 THEN concat('https://www.twitter.com/user', {_C})
  WHEN 14 THEN concat('https://youtube.com/shorts/', lpad({_K}, 11, '_'), '#top')
  ELSE concat('https://a.b.youtube.com/watch?v=', lpad({_K}, 11, 'c')) END"""

_E = "CAST(event_id AS STRING)"
_U = "CAST(user_id AS STRING)"

GUARD_URL = f"""CASE event_id % 13
  WHEN 0 THEN concat('http://10.0.', CAST(event_id % 256 AS STRING), '.', CAST(user_id % 256 AS STRING), '/a')
  WHEN 1 THEN concat('https://8.8.', CAST(event_id % 256 AS STRING), '.', CAST(user_id % 256 AS STRING), '/')
  WHEN 2 THEN concat('http://172.', CAST(event_id % 40 AS STRING), '.0.1:8080/x')
  WHEN 3 THEN 'http://169.254.169.254/latest'
  WHEN 4 THEN concat('ftp://host', {_U}, '/f')
  WHEN 5 THEN concat('http://host', {_U}, '.example.net/', {_E})
  WHEN 6 THEN 'http://[::1]/'
  WHEN 7 THEN 'http://[2606:4700::1111]/'
  WHEN 8 THEN concat('http:///nohost', {_E})
  WHEN 9 THEN concat('http://', CAST(event_id % 256 AS STRING), '.1.1.1/')
  WHEN 10 THEN concat('https://HOST', {_U}, '.example.net:443/', {_E})
  WHEN 11 THEN 'http://100.64.0.1/'
  ELSE concat('http://192.168.', CAST(event_id % 256 AS STRING), '.9/') END"""

_V, _T = "CAST(conv_id AS STRING)", "CAST(turn AS STRING)"

# name -> (base table, expressions)
DERIVED: dict[str, tuple[str, list[str]]] = {
    "post_urls": ("orders", ["o_orderkey AS id", f"{POST_URL} AS url"]),
    "local_paths": ("orders", [
        f"CASE WHEN o_orderkey % 48 = 11 THEN concat('not a url ', {_K}) ELSE concat('/files/', {_K}) END AS path"]),
    "guard_urls": ("events", ["event_id AS id", f"{GUARD_URL} AS url"]),
    # One host in four has an inner address; one user in seven is not resolved at all.
    "resolved": ("events", [
        f"concat(CASE WHEN user_id % 7 = 0 THEN 'other' ELSE 'host' END, {_U}, '.example.net') AS host",
        "CASE WHEN user_id % 4 = 0 THEN concat('10.1.1.', CAST(user_id % 250 AS STRING)) "
        "ELSE concat('8.8.4.', CAST(user_id % 250 AS STRING)) END AS ip", "user_id"]),
    # Redirect hops between order pages: every order points to the next one of its block of 16.
    "hop_table": ("orders", [
        f"concat('http://h.example.com/o/', {_K}) AS url",
        "CASE WHEN o_orderkey % 16 = 15 THEN 200 WHEN o_orderkey % 5 = 0 THEN 301 ELSE 302 END AS status",
        "CASE WHEN o_orderkey % 97 = 0 THEN 'http://127.0.0.1/x' "
        "WHEN o_orderkey % 16 = 15 THEN NULL "
        "ELSE concat('/o/', CAST(o_orderkey + 1 AS STRING)) END AS location"]),
    "redirect_starts": ("orders", ["o_orderkey AS id", f"concat('http://h.example.com/o/', {_K}) AS url"]),
    "raw_captures": ("pages", [
        "page_id", "url",
        "CASE page_id % 4 WHEN 0 THEN concat('{\"html\":\"<p>page ', CAST(page_id AS STRING), "
        "'</p>\",\"finalUrl\":\"', CASE WHEN page_id % 8 = 0 THEN '' ELSE concat('https://f.example.com/', "
        "CAST(page_id AS STRING)) END, '\",\"status\":', CASE WHEN page_id % 3 = 0 THEN '0' ELSE '404' END, "
        "',\"cookies\":[{\"name\":\"a\",\"value\":\"', CAST(page_id AS STRING), '\"}],\"userAgent\":\"UA\"}') "
        "WHEN 1 THEN concat('{broken ', html) ELSE html END AS raw"]),
    "responses": ("pages", [
        "page_id", "url", "html AS body",
        "CASE page_id % 23 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 0 "
        "WHEN 5 THEN 403 ELSE 200 END AS status",
        "CASE WHEN page_id % 5 = 0 THEN 'AkamaiGHost' WHEN page_id % 5 = 1 THEN 'cloudflare' ELSE 'nginx' END "
        "AS server",
        "CASE WHEN page_id % 7 = 0 THEN 'AA~-1~bb' WHEN page_id % 7 = 1 THEN 'AA~0~bb' ELSE '' END AS abck",
        "CASE WHEN page_id % 3 = 0 THEN 'TS01abc' WHEN page_id % 3 = 1 THEN 'DATADOME' ELSE 'sid' END AS cookie",
        "CASE WHEN page_id % 4 = 0 THEN 'X-Akamai-Edge' WHEN page_id % 4 = 1 THEN 'CF-Ray' ELSE 'Date' END "
        "AS header"]),
    # Twelve or so attempts per request; every eleventh got no response.
    "attempts": ("events", [
        "user_id * 8 + event_id % 8 AS request_id", "event_id AS seq",
        "CASE event_id % 7 WHEN 0 THEN 'phase0' WHEN 1 THEN 'probe' WHEN 6 THEN 'fallback' ELSE 'grid' END AS phase",
        "CASE event_id % 7 WHEN 0 THEN 'phase0' WHEN 6 THEN 'playwright_real_chrome' ELSE 'curl_cffi' END AS executor",
        f"concat('https://h', {_U}, '.example.com/', {_E}) AS url",
        "CASE event_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'mobile_subdomain' ELSE 'drop_www' END AS url_transform",
        "CASE event_id % 7 WHEN 0 THEN NULL WHEN 6 THEN NULL ELSE CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END END "
        "AS impersonate",
        "'self_root' AS referer",
        "CASE event_type WHEN 'signup' THEN 'weak_ok' WHEN 'view' THEN 'challenge' WHEN 'click' THEN 'suspect_ok' "
        "WHEN 'error' THEN 'blocked' ELSE CASE WHEN event_id % 5 = 0 THEN 'not_found' ELSE 'rate_limited' END END "
        "AS verdict",
        "CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS error",
        "CASE user_id % 3 WHEN 0 THEN 'aws_waf' WHEN 1 THEN 'unknown_challenge' END AS profile"]),
    "outcomes": ("events", [
        f"concat('h', {_U}, '.example.com::', CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END) AS key",
        "ts", "event_id", "event_type IN ('signup', 'purchase') AS ok",
        "CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'rate_limited' "
        "ELSE 'exhausted' END ELSE 'budget' END AS stop_reason",
        "CASE WHEN value < 20 THEN 'r1' ELSE 'r2' END AS route"]),
    "requests": ("events", [
        "event_id", f"concat('https://H', {_U}, '.example.com/p/', {_E}) AS url",
        "CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'auto' ELSE 'desktop' END AS device"]),
    "provider_calls": ("events", [
        "user_id AS session", "event_id AS seq",
        "CASE event_id % 4 WHEN 0 THEN 'gemini' WHEN 1 THEN 'nim_gemma4' WHEN 2 THEN 'nim_nemotron' ELSE 'groq' END "
        "AS provider",
        "CASE event_type WHEN 'signup' THEN 200 WHEN 'view' THEN 429 WHEN 'click' THEN 403 WHEN 'error' THEN 500 "
        "ELSE 402 END AS http_status",
        "CASE WHEN event_id % 9 = 0 THEN '{\"error\":{\"status\":\"RESOURCE_EXHAUSTED\",\"details\":[{\"@type\":\"x.QuotaFailure\",\"violations\":"
        "[{\"quotaId\":\"GenerateRequestsPerDayPerProject\"}]}]}}' "
        "WHEN event_id % 9 = 1 THEN '{\"error\":{\"details\":[{\"@type\":\"x.QuotaFailure\",\"violations\":"
        "[{\"quotaId\":\"GenerateRequestsPerMinute\"}]}]}}' WHEN event_id % 9 = 2 THEN 'no Credit left' "
        "WHEN event_id % 9 = 3 THEN '{\"text\":\"hello\"}' ELSE 'plain' END AS body"]),
    # A conversation is a thread: turn 0 is its root.  Every fourth thread lost its root.
    "thread_posts": ("conversations", [
        "conv_id AS thread_id", f"concat('https://t.example.com/', {_V}) AS source", f"concat('k', {_V}, '_0') AS root_code",
        "turn AS seq", f"concat('p', {_V}, '_', {_T}) AS id",
        f"concat('k', {_V}, '_', CAST(CASE WHEN conv_id % 4 = 3 AND turn = 0 THEN 99 ELSE turn END AS STRING)) AS code",
        "role AS author", "CASE WHEN turn % 6 = 5 THEN NULL ELSE text END AS text",
        "CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) % 50 END AS likes",
        "CASE WHEN turn = 0 THEN length(text) % 6 ELSE turn % 3 END AS reply_count",
        "CASE WHEN turn % 2 = 0 THEN concat('i', CAST(turn AS STRING)) END AS image",
        "CASE WHEN turn % 3 = 0 THEN concat('v', CAST(turn AS STRING)) END AS video",
        f"CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN concat('/m/', {_V}, '_', {_T}, '.jpg') END AS saved"]),
    # The same post is seen several times under three ids per conversation.
    "sightings": ("conversations", [
        "conv_id AS thread_id", "turn AS seq",
        f"CASE WHEN turn % 7 = 6 THEN NULL ELSE concat('p', CAST(turn % 3 AS STRING)) END AS id", "role AS author",
        "text", "length(text) AS likes"]),
    "leads": ("conversations", [
        "conv_id AS crawl_id", "turn AS seq", "role AS author",
        "CASE WHEN turn % 5 = 4 THEN NULL ELSE concat('c', CAST(turn % 4 AS STRING)) END AS code",
        "CASE WHEN turn % 6 = 5 THEN 0 ELSE 1 + turn END AS reply_count"]),
    "visited_pages": ("conversations", [
        "conv_id AS crawl_id", "concat('https://www.threads.net/@', CASE WHEN turn < 2 THEN role ELSE 'else' END, "
        "'/post/c', CAST(turn AS STRING)) AS url"]),
    # A page per turn of a conversation; its posts lead to the pages of the next turns.
    "page_posts": ("conversations", [
        f"concat('https://www.threads.net/@u/post/', {_V}, '-', {_T}) AS page_url", "1 AS seq",
        f"concat('p', {_V}, '-', CAST(turn + 1 AS STRING)) AS id", "'u' AS author",
        f"concat({_V}, '-', CAST(turn + 1 AS STRING)) AS code", "1 AS reply_count", "role AS text", "conv_id", "turn"]),
    "payloads": ("conversations", [
        "conv_id", "turn",
        f"concat('{{\"data\":{{\"edges\":[{{\"node\":{{\"thread_items\":[{{\"post\":{{\"id\":\"', {_V}, '-', {_T}, "
        f"'\",\"code\":\"k', {_T}, '\",\"user\":', CASE WHEN turn % 7 = 6 THEN 'null' ELSE concat('{{\"username\":\"', "
        f"role, '\"}}') END, ',\"caption\":{{\"text\":\"t', CAST(length(text) AS STRING), '\"}},', "
        f"CASE WHEN turn % 3 = 0 THEN '' ELSE concat('\"like_count\":', {_T}, ',') END, '\"text_post_app_info\":', "
        f"CASE WHEN turn % 5 = 4 THEN 'null' ELSE concat('{{\"direct_reply_count\":', {_T}, '}}') END, "
        f"',\"image_versions2\":{{\"candidates\":[{{\"url\":\"a\",\"width\":100}},{{\"url\":\"b\",\"width\":200}},"
        f"{{\"url\":\"c\",\"width\":200}},{{\"width\":900}}]}},\"quoted\":{{\"post\":{{\"id\":\"q', {_V}, '-', {_T}, "
        f"'\",\"user\":{{\"username\":\"q\"}},\"carousel_media\":[{{\"video_versions\":[{{\"url\":\"v1\",\"width\":null}},"
        f"{{\"url\":\"v2\",\"width\":0}}],\"image_versions2\":{{\"candidates\":[{{\"url\":\"cover\",\"width\":9}}]}}}},"
        f"{{\"image_versions2\":{{\"candidates\":[{{\"url\":\"d\",\"width\":1}}]}}}}]}}}}}}}}]}}}}],"
        f"\"relatedPosts\":{{\"items\":[{{\"post\":{{\"id\":\"r', {_V}, '\"}}}}]}}}}}}') AS body"]),
    "video_stats": ("orders", [
        "o_orderkey AS id", "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN 0 "
        "WHEN o_orderkey % 11 = 2 THEN -5 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS view_count",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS like_count", "o_orderkey % 100 AS comment_count"]),
    "downloads_state": ("lineitem", [
        "l_orderkey * 8 + l_linenumber AS id", "l_linenumber % 2 = 0 AS with_video", "l_quantity > 5 AS ok",
        "l_returnflag <> 'R' AS got_video", "l_tax > 0.04 AS clipped", "l_linestatus = 'O' AS from_start",
        "CASE l_linenumber % 4 WHEN 0 THEN 'is_live' WHEN 1 THEN 'was_live' WHEN 2 THEN 'not_live' END AS live_status",
        "l_linenumber > 2 AS with_chat", "CASE WHEN l_discount > 0.07 THEN 'failed' ELSE 'ok' END AS chat_status",
        "CASE WHEN l_quantity > 10 THEN '/c' END AS chat_path", "l_linenumber - 4 AS chat_count"]),
    "segments": ("conversations", [
        "conv_id AS video_id", "turn AS seq",
        "CASE turn % 5 WHEN 0 THEN concat(' a  b', chr(10), 'c', chr(9), ' ', role) WHEN 1 THEN 'a b c user' "
        "WHEN 2 THEN '   ' WHEN 3 THEN text ELSE NULL END AS text"]),
    "video_comments": ("conversations", [
        "conv_id AS video_id", "turn AS seq", "role AS author", "text", "CAST(length(text) AS STRING) AS votes",
        "'1d' AS time", "turn % 2 = 0 AS heart", "turn % 3 = 0 AS reply", "conv_id % 6 = 5 AND turn = 2 AS is_error"]),
    "output_files": ("lineitem", [
        "l_orderkey AS video_id",
        "concat('/v/', CAST(l_orderkey AS STRING), '.', CAST(l_partkey AS STRING), CASE l_linenumber % 8 "
        "WHEN 0 THEN '.mp4' WHEN 1 THEN '.ko.VTT' WHEN 2 THEN '.live_chat.json' WHEN 3 THEN '.mp4.part' "
        "WHEN 4 THEN '.srv3' WHEN 5 THEN '.webm' WHEN 6 THEN '.info.json' ELSE '.f1.ytdl' END) AS path"]),
    "infos": ("orders", [
        f"concat('https://www.youtube.com/watch?v=', lpad({_K}, 11, 'A')) AS source",
        f"""concat('{{"id":"', lpad({_K}, 11, 'A'), '","title":"T', {_C}, '","description":', CASE WHEN o_orderkey % 3 = 0 """
        f"""THEN 'null' ELSE concat('"d', {_K}, '"') END, ',"view_count":', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE """
        f"""CAST(o_orderkey % 4 AS STRING) END, ',"like_count":1,"uploader":"u","duration":12.5,"was_live":true,"""
        f""""subtitles":{{"ko":[{{"ext":"vtt"}}],"en":[]}},"automatic_captions":', CASE WHEN o_orderkey % 2 = 0 THEN '{{}}' """
        f"""ELSE '{{"ja":[]}}' END, ',"chapters":[{{"t":1}}]}}') AS info"""]),
    "dumps": ("orders", [
        f"concat('https://www.tiktok.com/@u/video/', {_K}) AS source", "o_orderkey % 3 <> 0 AS downloaded",
        f"""CASE o_orderkey % 4 WHEN 0 THEN concat('[[2,{{"id":"x"}}],[3,{{"id":"', {_K}, '","desc":"d', {_K}, """
        f"""'","createTime":"1700000000","author":{{"uniqueId":"","nickname":"nick","verified":true}},"stats":{{"diggCount":5}}}}]]') """
        f"""WHEN 1 THEN concat('[[1],[2,{{"id":"', {_K}, '","createTime":"bad","author":{{"uniqueId":"u', {_C}, '"}}}}]]') """
        f"""WHEN 2 THEN '[[1,"text"]]' ELSE 'not json' END AS dump"""]),
    "photo_posts": ("orders", [
        f"concat('https://www.instagram.com/p/P', {_K}, '/') AS source", f"concat('P', {_K}) AS shortcode",
        f"CASE WHEN o_orderkey % 7 <> 0 THEN concat('cap ', {_K}) END AS caption", "o_orderpriority AS owner",
        "o_orderkey AS post_id", "o_custkey AS likes", "o_orderkey % 9 AS comment_count", "o_orderkey % 2 = 0 AS is_video",
        "o_orderdate AS date_utc", "CASE WHEN o_orderkey % 10 = 9 THEN 'connection' END AS access_error",
        "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ok' WHEN 2 THEN 'login_required' WHEN 3 THEN 'boom' ELSE 'ok' END "
        "AS comments_error"]),
    "photo_comments": ("lineitem", [
        "concat('P', CAST(l_orderkey AS STRING)) AS shortcode", "l_linenumber AS seq",
        "CAST(l_partkey AS STRING) AS id", "l_returnflag AS author", "l_linestatus AS text",
        "CAST(l_quantity AS BIGINT) AS likes", "l_shipdate AS created_at"]),
    # Listing pages of a conversation's turns: 30 items each until the page of its last turn, which is short.
    "list_pages": ("conversations", [
        "concat('b', CAST(conv_id AS STRING)) AS blog_id", "turn + 1 AS page",
        "CASE WHEN conv_id % 5 = 4 AND turn = 1 THEN 500 ELSE 200 END AS status",
        "CASE WHEN conv_id % 7 = 6 AND turn = 2 THEN '{\"result\":[]}' WHEN conv_id % 7 = 5 AND turn = 1 THEN '{broken' "
        "ELSE concat('{\"result\":{\"items\":[', CASE WHEN turn % 3 = 2 THEN repeat('{\"n\":1},', 11) "
        "ELSE repeat('{\"n\":1},', 29) END, '{\"n\":1}]}}') END AS body"]),
    "blog_posts": ("orders", [
        f"concat('b', CAST(o_custkey % 10 AS STRING)) AS blog_id",
        f"CASE WHEN o_orderkey % 13 = 0 THEN concat('x', {_K}) ELSE {_K} END AS log_no",
        "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('og ', o_orderpriority) END AS og_title"]),
    "listing": ("orders", [
        f"concat('b', CAST(o_custkey % 10 AS STRING)) AS blog_id", f"{_K} AS log_no",
        "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('in ', o_orderstatus) END AS title_with_inspect",
        "concat('t ', o_orderstatus) AS title", "CAST(o_orderdate AS STRING) AS add_date", "o_orderstatus AS category",
        "o_orderkey % 5 AS comment_count", "o_orderkey % 50 AS read_count", "o_orderkey % 3 AS sympathy_count",
        "o_custkey % 4 AS like_count"]),
    "image_urls": ("lineitem", [
        "l_partkey * 4 + l_linenumber % 4 AS image_id",
        "concat('https://', CASE l_linenumber % 4 WHEN 0 THEN 'blogfiles' WHEN 1 THEN 'postfiles' "
        "WHEN 2 THEN 'mblogthumb-phinf' ELSE 'other' END, '.pstatic.net/i', CAST(l_partkey AS STRING), '.jpg?type=w80') AS url"]),
    "image_answers": ("part", ["p_partkey", "p_size", "p_retailprice"]),
    "size_labels": ("lineitem", [
        "l_orderkey AS post_id", "l_linenumber AS position",
        "CASE l_partkey % 6 WHEN 0 THEN 'original' WHEN 1 THEN 'original_w3840' WHEN 2 THEN 'w966_ceiling' "
        "WHEN 3 THEN 'thumbnail_fallback' WHEN 4 THEN 'odd' END AS label"]),
    "counted_texts": ("documents", [
        "doc_id", "concat(text, CASE doc_id % 5 WHEN 0 THEN ' 좋아요 1,234개 댓글: 56' WHEN 1 THEN ' Likes 7 Comments 8,000' "
        "WHEN 2 THEN ' Like this and that 9 Comment 3' ELSE '' END) AS text"]),
    # Articles of a profile: the same permalink is seen in several scrolls.
    "articles": ("conversations", [
        "conv_id % 20 AS profile", "turn AS scroll", "conv_id AS pos",
        "CASE turn % 3 WHEN 0 THEN concat('https://www.facebook.com/u/posts/', CAST(conv_id % 50 AS STRING), '?s=', "
        "CAST(turn AS STRING)) END AS permalink", "CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS text"]),
    "timeline_media": ("lineitem", [
        "l_suppkey AS profile", "l_orderkey * 8 + l_linenumber AS post_seq",
        "concat('https://scontent.fbcdn.net/i', CAST(l_partkey % 40 AS STRING), '.jpg?o=', CAST(l_orderkey AS STRING)) AS i1",
        "concat('https://scontent.fbcdn.net/i', CAST(l_linenumber AS STRING), '.jpg?o=', CAST(l_orderkey AS STRING)) AS i2",
        "concat('https://scontent.fbcdn.net/v', CAST(l_partkey % 30 AS STRING), '.mp4?o=', CAST(l_orderkey AS STRING)) AS v1"]),
    "page_articles": ("lineitem", [
        "concat('https://www.facebook.com/', CASE l_orderkey % 4 WHEN 0 THEN 'share' ELSE concat('u', CAST(l_orderkey % 7 "
        "AS STRING)) END, '/posts/', CAST(l_orderkey AS STRING), CASE l_orderkey % 8 WHEN 4 THEN '?id=77' ELSE '' END) AS page_url",
        "l_linenumber AS pos",
        "CASE l_linenumber % 3 WHEN 0 THEN concat('/u', CAST(l_partkey % 7 AS STRING)) WHEN 1 THEN '/profile.php?id=77' END "
        "AS author_href"]),
    "comment_articles": ("conversations", [
        "conv_id AS post_id", "turn AS pos",
        "CASE turn % 7 WHEN 5 THEN ' ' WHEN 6 THEN 'Loading…' ELSE text END AS text",
        "CASE WHEN turn % 11 = 10 THEN 'loading' END AS aria_label",
        "CASE conv_id % 3 WHEN 0 THEN 'e' WHEN 1 THEN 'no such caption' END AS caption"]),
    "raw_comments": ("conversations", [
        "conv_id", "turn",
        "concat(' ', role, chr(10), CASE turn % 6 WHEN 0 THEN concat('hello ', CAST(conv_id AS STRING), chr(10), '15시간', "
        "chr(10), '좋아요', chr(10), '답글 달기', chr(10), '1,', lpad(CAST(turn AS STRING), 3, '0')) "
        "WHEN 1 THEN '50000' WHEN 2 THEN concat('ok', chr(10), '7', chr(10), 'Like', chr(10), '3', chr(10), 'Reply') "
        "WHEN 3 THEN concat('2h', chr(10), 'Like') WHEN 4 THEN concat('x', chr(10), chr(10), '9', chr(10), '8') "
        "ELSE 'plain' END) AS raw_text"]),
    "comment_stats": ("lineitem", [
        "l_orderkey * 8 + l_linenumber AS id", "l_linenumber <> 1 AS requested", "CAST(l_quantity AS INT) % 4 AS raw_count",
        "CAST(l_quantity AS INT) % 3 AS comment_count", "CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS parse_fail",
        "l_returnflag = 'A' AS expand_hit_cap", "l_discount > 0.08 AS expand_interrupted", "l_linestatus = 'O' AS body_matched",
        "l_partkey % 2 = 0 AS caption_given"]),
    "base_posts": ("orders", [
        f"concat('https://www.facebook.com/u/posts/', {_K}) AS permalink", "o_orderstatus AS text",
        "o_custkey AS likes", "o_orderkey % 6 AS comment_count"]),
    "viewer_images": ("lineitem", [
        "l_orderkey AS post_id", "l_linenumber AS pos", "l_linenumber % 3 AS side",
        "concat('https://scontent.fbcdn.net/p', CAST(l_partkey % 5 AS STRING), '.jpg?stp=a&o=', CAST(l_linenumber AS STRING)) "
        "AS url", "CASE l_returnflag WHEN 'A' THEN 'fetched' ELSE 'cached' END AS status",
        "concat('https://video.fbcdn.net/', CASE WHEN l_partkey % 5 = 0 THEN 'short' ELSE lpad(CAST(l_partkey % 5 AS STRING), "
        "22, 'v') END, '.mp4?o=', CAST(l_linenumber AS STRING)) AS video_url"]),
    "offers": ("lineitem", [
        "concat('https://', CASE WHEN l_suppkey % 9 = 0 THEN 'elsewhere.example.com' ELSE 'scontent.fbcdn.net' END, '/f', "
        "CAST(l_partkey AS STRING), '.PNG?stp=a_b&oh=', CAST(l_orderkey AS STRING)) AS url",
        "l_orderkey * 8 + l_linenumber AS seq",
        "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 404 ELSE 200 END AS status",
        "CAST(floor(l_extendedprice * 1000) AS BIGINT) AS bytes", "CAST(floor(l_extendedprice * 20) AS BIGINT) AS area"]),
    "held_files": ("part", [
        "concat('https://scontent.fbcdn.net/f', CAST(p_partkey AS STRING), '.PNG') AS base",
        "p_size * 100 AS bytes", "CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size * 40000 END AS area", "p_partkey"]),
    "media_docs": ("documents", [
        "concat('/docs/', CAST(doc_id AS STRING)) AS source", "CASE doc_id % 3 WHEN 0 THEN 'local' ELSE 'threads' END AS platform",
        "text AS body_text", "doc_id",
        "CASE WHEN doc_id % 5 = 4 THEN '' ELSE concat('/m/', source, '/', CAST(doc_id % 9 AS STRING), '.JPG,/m/', "
        "CAST(doc_id AS STRING), '.mp3,/m/', lang, '.png,/m/', CAST(doc_id % 4 AS STRING), '.mp4,/m/', "
        "CAST(doc_id AS STRING), '.pdf') END AS paths", "CASE WHEN doc_id % 10 = 3 THEN 'already there' END AS transcript"]),
    "ocr_calls": ("conversations", [
        "concat('/m/', CAST(conv_id AS STRING), '.jpg') AS media_path", "turn",
        "CASE turn % 3 WHEN 0 THEN 'nim_nemotron' WHEN 1 THEN 'gemini' ELSE 'nim_gemma4' END AS provider",
        "turn < 3 AND (conv_id + turn) % 3 <> 0 AND conv_id % 6 <> 5 AS ok", "concat(' ', text) AS text",
        "conv_id % 12 = 5 AND turn = 1 AS rate_limited", "conv_id % 6 = 5 AND turn <> 1 AS dead",
        "concat('m', CAST(turn AS STRING)) AS model", "turn < 2 AND conv_id % 4 <> 0 AS judge_ok",
        "CASE WHEN turn = 0 THEN 'judge' ELSE 'ocr' END AS role", "conv_id % 8 = 0 OR conv_id % 6 = 5 AS paid_ok"]),
    "speech_calls": ("conversations", [
        "concat('/m/', CAST(conv_id AS STRING), '.mp3') AS media_path", "turn AS seq",
        "CASE WHEN conv_id % 4 = 0 AND turn = 0 THEN 'local' ELSE 'groq' END AS backend",
        "CASE WHEN conv_id % 4 = 0 AND turn = 0 THEN 'large-v3' WHEN turn < 2 THEN 'whisper-large-v3-turbo' "
        "ELSE 'whisper-large-v3' END AS model",
        "CASE WHEN (conv_id + turn * 2) % 5 = 0 THEN 200 WHEN (conv_id + turn) % 7 = 6 THEN 500 ELSE 429 END AS status",
        "CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN NULL ELSE 61 END AS retry_after", "concat(text, ' ') AS text"]),
    "uploads": ("lineitem", [
        "l_orderkey * 8 + l_linenumber AS id",
        "concat('/m/', CAST(l_partkey AS STRING), CASE l_linenumber WHEN 1 THEN '.mp3' WHEN 2 THEN '.MP4' WHEN 3 THEN '.mkv' "
        "WHEN 4 THEN '.wma' WHEN 5 THEN '.flac' ELSE '.webm' END) AS path",
        "CAST(floor(l_extendedprice * 500) AS BIGINT) AS size_bytes",
        "CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(floor(l_quantity * 1000000) AS BIGINT) END AS extracted_bytes"]),
    "media_files": ("documents", [
        "doc_id", "text",
        "concat('/data/', source, '/doc', CAST(doc_id AS STRING), CASE doc_id % 10 WHEN 0 THEN '.TXT' "
        "WHEN 1 THEN '.md' WHEN 2 THEN '.mp4' WHEN 3 THEN '.Mp3' WHEN 4 THEN '.png' WHEN 5 THEN '.pdf' "
        "WHEN 6 THEN '.epub' WHEN 7 THEN '' WHEN 8 THEN '.tar.zip' ELSE '.webm' END) AS path"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived input."""
    if name in DERIVED:
        base, exprs = DERIVED[name]
        return table(spark, sf_dir, base).selectExpr(*exprs)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*names: str) -> str:
    """``WITH`` clause naming the derived inputs (bases first)."""
    done: list[str] = []

    def add(name: str) -> None:
        base = DERIVED[name][0]
        if base in DERIVED:
            add(base)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(
        f"{n} AS (SELECT {', '.join(DERIVED[n][1])} FROM {DERIVED[n][0]})" for n in done)

