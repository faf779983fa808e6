"""Photo and timeline platforms, and the union of all records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules, schema
from ..functions import ordered
from ..functions.parts import PART_ROWS, attach_parts, in_parts
from ..functions.text import strip, truthy, url_base
from .video import optional


def normalize_instagram(posts: DataFrame, comments: DataFrame | None = None, session_used: bool = False,
                        part_rows: int = PART_ROWS, fetched_at: Column | None = None) -> DataFrame:
    """Posts and their comments to records.

    ``posts``: source, shortcode, caption, owner, post_id, likes, comment_count, is_video, date_utc, access_error
    (null = read), comments_error (null = not requested, ok, login_required, connection, other), optional
    media_paths and downloaded.  ``comments``: shortcode, seq, id, author, text, likes, created_at.  A post that could
    not be read is a row with ``reject_reason``; many comments make several parts.
    """
    error = F.col("comments_error")
    label = (
        F.when(error.isNull(), "not_requested").when(error == "ok", "collected")
        .when(error.isin("login_required", "connection"), "login_required").otherwise("fetch_failed"))
    refused = F.when(F.col("access_error").isNotNull(), "session_failed" if session_used else "anonymous_blocked")
    rows = posts.withColumn("comments_label", label).withColumn("reject_reason", refused)
    if comments is None:
        joined = rows.withColumns({
            "part_no": F.lit(0), "part_count": F.lit(1), "comments": schema.no_comments(), "captured": F.lit(0)})
    else:
        comment = schema.comment(
            id=F.col("id"), author=F.col("author"), text=F.coalesce("text", F.lit("")),
            likes=F.coalesce("likes", F.lit(0)), created_at=F.col("created_at"))
        numbered = ordered.ordered_values(
            comments, ["shortcode"], ["seq"], ordered.chunk_of("seq"), running={"_n": F.lit(1)})
        parts = in_parts(numbered.withColumn("_n", F.col("_n") - 1), "shortcode", "_n", comment, "comments", part_rows)
        counts = comments.groupBy("shortcode").agg(F.count("*").alias("captured"))
        joined = attach_parts(rows.join(counts, "shortcode", "left"), parts, "shortcode").withColumn(
            "part_count", F.greatest(F.lit(1), F.ceil(F.coalesce("captured", F.lit(0)) / part_rows)))
    collected = (F.col("comments_label") == "collected") & F.col("reject_reason").isNull()
    paths = optional(posts, "media_paths", schema.no_paths())
    wanted = optional(posts, "downloaded", F.lit(False))
    media = F.when(~wanted, "none").when(F.size(paths) > 0, "downloaded").otherwise("download_failed")
    details = schema.meta(
        author=F.col("owner"), likes=F.coalesce("likes", F.lit(0)),
        comment_count_captured=F.when(collected, F.coalesce("captured", F.lit(0))).otherwise(0),
        fetched_at=F.lit(None) if fetched_at is None else fetched_at,
        extra={
            "shortcode": F.col("shortcode"),
            "post_id": F.col("post_id"), "comment_count": F.coalesce("comment_count", F.lit(0)),
            "local_media_count": F.when(F.size(paths) > 0, F.size(paths)), "comments_label": F.col("comments_label"), "is_video": F.coalesce("is_video", F.lit(False)),
            "media_label": media, "ig_access_label": F.coalesce("reject_reason", F.lit("ok")),
            "date_utc": F.date_format("date_utc", "yyyy-MM-dd'T'HH:mm:ss"),
        })
    kept = joined.filter(collected | (F.col("part_no") == 0)).withColumns({
        "part_no": F.col("part_no").cast("int"), "part_count": F.when(collected, F.col("part_count")).otherwise(1).cast("int")})
    # The caption and the media belong to the first part.
    first = F.col("part_no") == 0
    return schema.record(
        kept, F.col("source"), "instagram", F.when(first, F.coalesce("caption", F.lit(""))).otherwise(""), details,
        comments=F.when(collected, F.coalesce("comments", schema.no_comments())).otherwise(schema.no_comments()),
        media_paths=F.when(first, paths).otherwise(schema.no_paths()), keep=["part_no", "part_count", "reject_reason"])


def _count(text: Column, pattern: str) -> Column:
    return F.replace(truthy(F.regexp_extract(text, f"(?U){pattern}", 1)), F.lit(","), F.lit("")).try_cast("long")


def parse_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``likes`` and ``comment_count`` written in a post's text (Korean and English interface)."""
    return df.withColumn("likes", _count(F.col(text), rules.LIKES)).withColumn(
        "comment_count", _count(F.col(text), rules.COMMENTS))


def post_key(permalink: Column, text: Column, images: Column) -> Column:
    # The whole text: posts that only begin alike are different posts.
    head = F.when(truthy(text).isNotNull(), F.md5(text))
    n = F.greatest(F.coalesce(F.size(images), F.lit(0)), F.lit(0))
    return F.when(truthy(permalink).isNotNull(), url_base(permalink)).otherwise(
        F.concat(head, F.lit("|"), n.cast("string")))


def dedup_timeline(articles: DataFrame) -> DataFrame:
    """Repeated scroll snapshots (profile, scroll, pos, permalink, text, images); the first sighting stays."""
    keyed = articles.withColumn(
        "post_key", post_key(F.col("permalink"), F.col("text"), F.col("images"))).filter("post_key is not null")
    return ordered.first_by(keyed, ["profile", "post_key"], ["scroll", "pos"])


def dedup_media_across_posts(posts: DataFrame) -> DataFrame:
    """Profile-wide media (profile, post_seq, image_urls, video_urls).

    ``images_to_fetch`` holds an image only where its base URL comes first; ``video_urls`` loses videos seen in
    earlier posts, repeats inside one post stay.  A base URL's first post is a minimum of numbers, hashed and combined
    before the shuffle, so a picture half the profile repeats is reduced where it lies.  What a post won meets it by
    post, which no picture makes hot, and only media that won are regrouped, where the post lies.
    """
    at = ["profile", "post_seq"]
    listed = lambda urls, kind: F.transform(
        F.coalesce(urls, schema.no_paths()), lambda u, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), u.alias("url")))
    media = lambda df, *more: df.select(*at, *more, F.explode_outer(F.concat(
        listed(F.col("image_urls"), 0), listed(F.col("video_urls"), 1))).alias("m")).filter("m is not null").select(
        *at, *more, "m.*", url_base("m.url").alias("base"))
    # Every later step finds the posts where this puts them.
    posts = posts.repartition(*at)
    first = media(posts).filter("base is not null").groupBy("profile", "kind", "base").agg(F.min("post_seq").alias("post_seq"))
    wins = first.groupBy(*at).agg(F.collect_list(F.struct("kind", "base")).alias("_wins"))
    won = media(posts.join(wins, at), "_wins").filter(F.array_contains("_wins", F.struct("kind", "base"))).drop("_wins")
    # Of an image's repeats inside its post the first stays.
    items = won.groupBy(*at, "kind", "base").agg(F.min("pos").alias("first_pos"), F.collect_list(F.struct("pos", "url")).alias("_all"))
    kept = F.filter("_all", lambda x: (F.col("kind") == 1) | (x["pos"] == F.col("first_pos")))
    items = items.select(*at, "kind", F.transform(kept, lambda x: F.struct(F.col("first_pos"), x["pos"].alias("pos"), x["url"].alias("url"))).alias("_kept"))
    urls = lambda kind: F.transform(F.array_sort(F.flatten(F.collect_list(F.when(
        F.col("kind") == kind, F.col("_kept"))))), lambda x: x["url"])
    lists = items.groupBy(*at).agg(urls(0).alias("_i"), urls(1).alias("_v"))
    return posts.drop("video_urls").join(lists, at, "left").withColumns({
        "images_to_fetch": F.coalesce("_i", schema.no_paths()), "video_urls": F.coalesce("_v", schema.no_paths())}).drop("_i", "_v")


def owner_token(url: Column) -> Column:
    """Account a resolved permalink belongs to, null when the URL does not tell."""
    segment = F.regexp_extract(url, r"(?i)facebook\.com/([^/?#]+)/(?:posts|videos)/", 1)
    usable = (segment != "") & ~F.lower(segment).isin(rules.NOT_AN_OWNER)
    return F.when(usable, segment).otherwise(truthy(F.regexp_extract(url, r"[?&]id=(\d+)", 1)))


def focus_scope(articles: DataFrame) -> DataFrame:
    """Of a page's articles (page_url, pos, author_href) only the first one its owner wrote.

    A page on which none matches keeps all, with ``matched`` false.
    """
    owner = owner_token(F.col("page_url"))
    href = F.coalesce("author_href", F.lit(""))
    hit = href.contains(F.concat(F.lit("/"), owner)) | href.contains(F.concat(F.lit("id="), owner))
    focused = ordered.group_values(
        articles, ["page_url"], {"_focus": ("min", F.when(hit, F.col("pos")))}, ordered.chunk_of("pos"))
    return focused.filter(F.col("_focus").isNull() | (F.col("pos") == F.col("_focus"))).withColumn(
        "matched", F.col("_focus").isNotNull()).drop("_focus")


def comment_candidates(articles: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Comment articles of a post (post_id, pos from 0, text, aria_label, caption).

    The body is the first article holding the caption, else article 0 (``body_matched`` false).  What follows it,
    without loading placeholders and blanks, are the candidates; ``index`` counts from the body.  ``max_chars`` cuts
    texts and ``text_cut`` tells where.
    """
    text = F.coalesce("text", F.lit(""))
    caption = truthy("caption")
    bodies = ordered.group_values(
        articles, ["post_id"], {"_body": ("min", F.when(text.contains(caption), F.col("pos")))},
        ordered.chunk_of("pos"))
    body = F.coalesce("_body", F.lit(0))
    loading = F.coalesce("aria_label", F.lit("")).rlike(rules.LOADING) | text.rlike(rules.LOADING)
    return bodies.filter((F.col("pos") > body) & ~loading & (strip(text) != "")).select(
        "post_id", (F.col("pos") - body - 1).alias("index"),
        (text if max_chars is None else F.substr(text, F.lit(1), F.lit(max_chars))).alias("raw_text"),
        (F.lit(False) if max_chars is None else F.length(text) > max_chars).alias("text_cut"),
        F.col("_body").isNotNull().alias("body_matched"), caption.isNotNull().alias("caption_given"))


def parse_comments(df: DataFrame, raw: str = "raw_text") -> DataFrame:
    """``author``, ``text``, ``likes`` and ``parse_failed`` from a comment article's lines.

    The last lines that look like interface text go, from the first of them that is not a bare number on; bare
    numbers before it, or a tail of bare numbers only, belong to the text.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(raw), F.lit("")), "\n"), strip), lambda x: x != "")
    number = lambda x: x.rlike(r"^[,\d]*\d[,\d]*$")
    staged = df.withColumn("_lines", lines)
    staged = staged.withColumn("_body", F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1))))
    chrome = rules.COMMENT_META_LINE.replace("(?i)", "(?iU)")
    staged = staged.withColumn("_tail", F.coalesce(F.array_max(F.transform(
        "_body", lambda x, i: F.when(x.rlike(chrome), F.lit(0)).otherwise(i + 1))), F.lit(0)))
    staged = staged.withColumn("_cut", F.array_min(F.filter(F.transform(
        "_body", lambda x, i: F.when((i >= F.col("_tail")) & ~number(x), i)), lambda i: i.isNotNull())))
    kept = F.when(F.col("_cut").isNull(), F.col("_body")).otherwise(F.slice("_body", 1, F.col("_cut")))
    dropped = F.slice("_body", F.col("_cut") + 1, F.size("_body"))
    counts = F.filter(dropped, number)
    likes = F.when(F.col("_cut").isNotNull(), F.replace(
        F.try_element_at(counts, F.lit(-1)), F.lit(","), F.lit("")).try_cast("long"))
    return (
        staged.withColumn("author", F.get("_lines", F.lit(0)))
        .withColumn("text", strip(F.array_join(kept, "\n")))
        .withColumn("likes", likes)
        .withColumn("parse_failed", F.col("text") == "")
        .drop("_lines", "_body", "_tail", "_cut")
    )


def comments_label(stats: DataFrame) -> DataFrame:
    """One label for how complete a post's comments are.

    Needs requested, raw_count, comment_count, parse_fail, expand_hit_cap, expand_interrupted, body_matched,
    caption_given.
    """
    doubtful = (
        F.col("expand_hit_cap") | F.col("expand_interrupted") | (F.col("parse_fail") > 0)
        | (F.col("caption_given") & ~F.col("body_matched")))
    asked = F.coalesce(F.col("requested"), F.lit(True)) if "requested" in stats.columns else F.lit(True)
    return stats.withColumn(
        "comments_label",
        F.when(~asked, "not_collected")
        .when(F.col("comment_count") == 0, F.when(F.col("raw_count") > 0, "fetch_failed").otherwise("none"))
        .when(doubtful, "partial").otherwise("collected"))


def merge_enriched(base: DataFrame, img: DataFrame | None = None, vid: DataFrame | None = None,
                   cmt: DataFrame | None = None) -> DataFrame:
    """Base posts with what re-visits found; every table is unique on ``permalink``.

    Text, images and videos of a re-visit win when not empty; likes and the comment count stay the base's.
    """
    def side(df: DataFrame | None, cols: dict[str, str], name: str) -> DataFrame:
        if df is None:
            return base.sparkSession.createDataFrame([], f"permalink string, {name} struct<" + ",".join(
                f"{c}:{t}" for c, t in cols.items()) + ">")
        return df.select("permalink", F.struct(*[F.col(c).cast(t).alias(c) for c, t in cols.items()]).alias(name))

    paths = "array<string>"
    out = base
    for df, cols, name in [
        (img, {"text": "string", "image_urls": paths, "local_images": paths, "fullsize_label": "string"}, "_i"),
        (vid, {"video_urls": paths, "local_videos": paths, "video_label": "string"}, "_v"),
        (cmt, {"comments": f"array<{schema.COMMENT}>", "comments_label": "string"}, "_c"),
    ]:
        out = out.join(side(df, cols, name), "permalink", "left")
    filled = lambda new, old: F.when(F.size(new) > 0, new).otherwise(F.coalesce(old, schema.no_paths()))
    none = schema.no_paths()
    return out.select(
        "permalink",
        F.coalesce(truthy(F.col("_i.text")), F.col("text"), F.lit("")).alias("text"),
        filled(F.col("_i.image_urls"), F.col("image_urls")).alias("image_urls"),
        filled(F.col("_i.local_images"), F.col("local_images")).alias("local_images"),
        F.coalesce("_i.fullsize_label", "image_label", F.lit("none")).alias("fullsize_label"),
        filled(F.col("_v.video_urls"), F.col("video_urls")).alias("video_urls"),
        F.coalesce("_v.local_videos", none).alias("local_videos"),
        F.coalesce("_v.video_label", F.lit("none")).alias("video_label"),
        "likes", "comment_count",
        F.lit(cmt is not None).alias("comments_requested"),
        F.coalesce("_c.comments", schema.no_comments()).alias("comments"),
        F.when(F.lit(cmt is None), "not_collected").otherwise(F.coalesce("_c.comments_label", F.lit("none")))
        .alias("comments_label"))


def select_images(viewer: DataFrame, article: DataFrame, downloads: DataFrame | None = None,
                  max_photos: int | None = None) -> DataFrame:
    """Images of a post (post_id, pos, url), full-size viewer before article, first of equal base URLs.

    ``max_photos`` keeps the first viewer pages of a post only.  ``downloads`` (url, status) raises the label of a post when a
    larger file arrived.  Rows keep (priority, pos) as their order.
    """
    walked = viewer if max_photos is None else ordered.first_by(viewer, ["post_id"], ["pos"], max_photos)
    both = walked.select("post_id", F.lit(1).alias("priority"), "pos", "url").unionByName(
        article.select("post_id", F.lit(2).alias("priority"), "pos", "url"))
    kept = both.groupBy("post_id", url_base("url").alias("base")).agg(
        F.min(F.struct("priority", "pos", "url")).alias("_k")).select("post_id", "_k.*")
    if downloads is None:
        kept = kept.withColumn("_grown", F.lit(0))
    else:
        status = downloads.groupBy("url").agg(
            F.max(F.col("status").isin("fetched", "upgraded").cast("int")).alias("_grown"))
        kept = ordered.lookup(kept, status, ["url"])
    graded = ordered.group_values(
        kept, ["post_id"], {"_best": ("min", F.col("priority")), "_any": ("max", F.coalesce("_grown", F.lit(0)))},
        ordered.spread_of("url"))
    label = F.when(F.col("_best") == 1, "fullsize_viewer").otherwise("article_thumbnail")
    lower = F.col("_best") != 1
    return graded.select(
        "post_id", "priority", "pos", "url",
        F.when((F.col("_any") == 1) & lower, "largest_cdn").otherwise(label).alias("fullsize_label"))


def video_id(url: Column) -> Column:
    return truthy(F.regexp_extract(url, r"/([A-Za-z0-9_-]{20,})\.(?:mp4|m4s)", 1))


def select_videos(captured: DataFrame, dom: DataFrame) -> DataFrame:
    """Videos of a post (post_id, pos, url), network captures before page scans, one per video id."""
    both = captured.select("post_id", F.lit(1).alias("priority"), "pos", "url").unionByName(
        dom.select("post_id", F.lit(2).alias("priority"), "pos", "url")).withColumn("video_id", video_id(F.col("url")))
    kept = both.filter("video_id is not null").groupBy("post_id", "video_id").agg(
        F.min(F.struct("priority", "pos", "url")).alias("_k")).select("post_id", "video_id", "_k.*")
    graded = ordered.group_values(
        kept, ["post_id"], {"_best": ("min", F.col("priority"))}, ordered.spread_of("video_id"))
    return graded.select(
        "post_id", "video_id", "priority", "pos", "url",
        F.when(F.col("_best") == 1, "network_capture").otherwise("dom_scan").alias("video_label"))


def strip_stp(url: Column) -> Column:
    """The URL without its ``stp`` parameter, which asks for a smaller image."""
    out = F.regexp_replace(F.regexp_replace(url, r"\?stp=[^&]*", "?"), r"&stp=[^&]*", "")
    return F.regexp_replace(F.replace(out, F.lit("?&"), F.lit("?")), r"[?&]+$", "")


def file_key(url: Column) -> Column:
    """Stable file name of an image: hash of the URL before its query, and the extension."""
    base = url_base(url)
    ext = F.lower(F.coalesce(truthy(F.regexp_extract(base, r"(?i)\.(jpg|jpeg|png|gif|webp)", 1)), F.lit("jpg")))
    return F.concat(F.lit("fb_"), F.substr(F.md5(base), F.lit(1), F.lit(12)), F.lit("."), ext)


def upgrade_media(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Decide per file whether a larger download replaces what is there.

    ``existing``: file_key, bytes, area.  ``incoming``: url, seq, status (null = no response), bytes, area; a URL and
    its ``stp``-free form compete for one file.  Result: file_key, action, used_url, area.
    """
    usable = (F.col("status") == 200) & F.col("bytes").between(rules.MIN_PHOTO_BYTES, rules.MAX_PHOTO_BYTES)
    allowed = F.col("_host_ok")
    keyed = incoming.withColumns({
        "file_key": file_key(F.col("url")),
        "_host_ok": F.col("url").rlike(r"(?iU)^https?://(?:[\w-]+\.)*fbcdn\.net/")})
    # Numbers first, in hash aggregates: the largest area, then its first offer; the URL is fetched for that one only.
    fit = keyed.filter(usable & allowed)
    largest = fit.groupBy("file_key").agg(F.max("area").alias("area"))
    best = fit.join(largest, ["file_key", "area"]).groupBy("file_key", "area").agg(F.min("seq").alias("seq"))
    best = fit.join(best, ["file_key", "area", "seq"]).groupBy("file_key").agg(
        F.max(F.struct("area", "url")).alias("_best"))
    offers = keyed.groupBy("file_key").agg(
        F.coalesce(F.bool_or(F.col("status").isNotNull() & allowed), F.lit(False)).alias("_answered"),
        F.bool_or(allowed).alias("_allowed")).join(best, "file_key", "left")
    kept = existing.groupBy("file_key").agg(
        F.max(F.when(F.col("bytes") > rules.MIN_PHOTO_BYTES, F.col("area"))).alias("_have"))
    both = kept.join(offers, "file_key", "full_outer")
    have, best = F.coalesce("_have", F.lit(0)), F.col("_best")
    action = (
        F.when(F.col("_allowed").isNull(), "kept_existing")
        .when(~F.col("_allowed"), "skip_host")
        .when(have >= rules.GOOD_AREA, "cached")
        .when(best.isNull(), F.when(have > 0, "kept_existing").when(F.col("_answered"), "all_fail").otherwise("req_err"))
        .when((have > 0) & (best["area"] <= have), "kept_existing")
        .when(have > 0, "upgraded").otherwise("fetched"))
    out = both.withColumn("action", action)
    taken = F.col("action").isin("upgraded", "fetched")
    return out.select(
        "file_key", "action", F.when(taken, best["url"]).alias("used_url"),
        F.when(taken, best["area"]).otherwise(have).cast("long").alias("area"))


def normalize_facebook(posts: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """Merged posts to the normalized record; images come before videos."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    asked = optional(posts, "comments_requested", F.lit(False))
    comments = F.when(asked, optional(posts, "comments", schema.no_comments())).otherwise(schema.no_comments())
    local = lambda c: optional(posts, c, schema.no_paths())
    details = schema.meta(
        likes=F.col("likes"),
        comment_count_captured=F.when(asked, F.size(comments)),
        fetched_at=F.lit(None) if fetched_at is None else fetched_at,
        extra={
            "permalink": F.col("permalink"), "image_count": size("image_urls"), "video_count": size("video_urls"),
            "local_image_count": size(local("local_images")), "local_video_count": size(local("local_videos")),
            "fullsize_label": optional(posts, "fullsize_label", F.lit("none")),
            "video_label": optional(posts, "video_label", F.lit("none")),
            "comment_count": F.col("comment_count"),
            "comments_label": F.when(asked, optional(posts, "comments_label", F.lit("not_collected")))
            .otherwise("not_collected"),
        })
    return schema.record(
        posts, optional(posts, "source", F.col("permalink")), "facebook", F.coalesce("text", F.lit("")), details,
        comments=comments, media_paths=F.concat(local("local_images"), local("local_videos")))


def union_documents(*dfs: DataFrame) -> DataFrame:
    """All platform outputs as one table; columns a platform lacks are null, but every record is part 0 of 1."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    one = {c: F.coalesce(F.col(c) if c in whole.columns else F.lit(None), F.lit(v)).cast("int")
           for c, v in (("part_no", 0), ("part_count", 1))}
    return whole.withColumns(one)
