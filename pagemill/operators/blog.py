"""Blog posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules, schema
from ..functions import ordered
from ..functions.text import truthy, url_base, whole_json


def concat_list_pages(pages: DataFrame, page_size: int = 30, max_posts: int | None = None) -> DataFrame:
    """Listing pages (blog_id, page from 1, status, body) to items in order.

    Reading ends before the first missing, failed, unparseable or empty page and after the first short one;
    ``max_posts`` keeps the first items of a blog only.  Result: blog_id, position (from 0), item (VARIANT).
    """
    parsed = F.try_parse_json(whole_json("body"))
    is_object = F.try_variant_get(parsed, "$.result", "map<string,variant>").isNotNull()
    items = F.when(is_object, F.try_variant_get(parsed, "$.result.items", "array<variant>"))
    usable = (F.col("status") == 200) & (F.coalesce(F.col("body"), F.lit("")) != "")
    sized = pages.select("blog_id", "page", F.when(usable, items).alias("_items"))
    n = F.greatest(F.coalesce(F.size("_items"), F.lit(0)), F.lit(0))
    sized = sized.withColumn("_n", n)
    counted = ordered.ordered_values(
        sized, ["blog_id"], ["page"], ordered.chunk_of("page", 1024),
        running={"_rank": F.lit(1), "_bad": (F.col("_n") == 0).cast("int"),
                 "_short": (F.col("_n") < page_size).cast("int"), "_seen": F.col("_n")})
    is_short = (F.col("_n") < page_size).cast("int")
    read = counted.filter((F.col("_bad") == 0) & (F.col("_short") - is_short == 0) & (F.col("_rank") == F.col("page")))
    rows = read.select("blog_id", (F.col("_seen") - F.col("_n")).alias("_before"),
                       F.posexplode_outer("_items").alias("_i", "item"))
    placed = rows.select("blog_id", (F.col("_before") + F.col("_i")).alias("position"), "item").filter("position IS NOT NULL")
    return placed if max_posts is None else placed.filter(F.col("position") < max_posts)


def join_listing(posts: DataFrame, listing: DataFrame) -> DataFrame:
    """Posts (blog_id, log_no, og_title, ...) with their listing entry.

    Listing columns: blog_id, log_no, title_with_inspect, title, add_date, category, comment_count, read_count,
    sympathy_count, like_count.  An empty title or a like count of 0 falls through to the next source.  A malformed
    log_no gets a ``reject_reason`` and nothing else happens to the batch.
    """
    entries = listing.select(
        "blog_id", "log_no", F.struct(
            "title_with_inspect", "title", "add_date", "category", "comment_count", "read_count", "sympathy_count",
            "like_count").alias("_l"))
    joined = ordered.lookup(posts, entries, ["blog_id", "log_no"])
    entry = F.col("_l")
    valid = F.coalesce(F.col("log_no").rlike(r"^\d{1,20}$"), F.lit(False))
    return joined.select(
        *posts.columns,
        F.coalesce(truthy("og_title"), truthy(entry["title_with_inspect"]), entry["title"]).alias("title"),
        entry["add_date"].alias("add_date"), entry["category"].alias("category"),
        entry["comment_count"].alias("comment_count"), entry["read_count"].alias("read_count"),
        F.coalesce(F.nullif(entry["sympathy_count"], F.lit(0)), entry["like_count"]).alias("like_count"),
        F.concat(F.lit("https://blog.naver.com/"), "blog_id", F.lit("/"), "log_no").alias("url"),
        F.when(~valid, "invalid log_no").alias("reject_reason"))


def normalize_naver(posts: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """Blog posts to the normalized record.  Needs source, log_no, title, body_text, image_urls, video_urls."""
    from .video import optional

    none = F.lit(None)
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    details = schema.meta(
        title=F.col("title"), fetched_at=none if fetched_at is None else fetched_at,
        extra={
            **{c: optional(posts, c, none) for c in ("log_no", "add_date", "category", "comment_count", "read_count",
                                                     "like_count")},
            "image_count": count("image_urls"), "video_count": count("video_urls"),
            "image_size_label": optional(posts, "image_size_label", F.lit("none")),
            "body_truncated": optional(posts, "body_truncated", F.lit(False)),
        })
    return schema.record(
        posts, F.col("source"), "naver_blog", F.coalesce("body_text", F.lit("")), details,
        media_paths=optional(posts, "media_paths", schema.no_paths()))


def image_plan(url: Column) -> Column:
    """Array of (priority, label, candidate): the size variants worth asking for, best first."""
    base = url_base(url)
    host = F.lower(F.regexp_extract(url, rules.BLOG_IMAGE_HOST, 1))
    step = lambda n, label, c: F.struct(
        F.lit(n).alias("priority"), F.lit(label).alias("label"), c.alias("candidate"))
    sized = lambda q: F.concat(base, F.lit(f"?type={q}"))
    inline = host.startswith("postfiles") | host.startswith("blogthumb") | host.startswith("mblogthumb")
    return (
        F.when(host.startswith("blogfiles"), F.array(
            step(1, "original", base), step(2, "original_w3840", sized("w3840"))))
        .when(inline, F.array(step(1, "w966_ceiling", sized("w966"))))
        .otherwise(F.array(step(1, "thumbnail_fallback", sized("w966")))))


def pick_image_variant(urls: DataFrame, responses: DataFrame, key: str = "image_id", url: str = "url") -> DataFrame:
    """Per image the first planned variant whose response is 200 and not a placeholder.

    ``responses``: url (unique), status, bytes.  Without one the label tells an error from a plain absence.
    """
    # An image is often listed many times: each is planned and looked up once.
    listed = urls.select(key, F.col(url).alias("_url")).distinct()
    planned = listed.select(key, F.explode_outer(image_plan(F.col("_url"))).alias("_p")).select(key, "_p.*")
    answers = responses.select(F.col("url").alias("candidate"), "status", "bytes")
    joined = ordered.lookup(planned, answers, ["candidate"])
    good = (F.col("status") == 200) & (F.col("bytes") >= rules.MIN_IMAGE_BYTES)
    per = joined.groupBy(key).agg(
        F.min(F.when(good, F.struct("priority", "label", "candidate"))).alias("_best"),
        F.coalesce(F.bool_or(F.col("status").isin(rules.IMAGE_ERROR_STATUSES)), F.lit(False)).alias("_error"))
    return per.select(
        key,
        F.coalesce("_best.label", F.when(F.col("_error"), "failed:error").otherwise("failed:notfound")).alias("label"),
        F.col("_best.candidate").alias("used_url"))


def best_size_label(labels: DataFrame, key: str = "post_id") -> DataFrame:
    """The best of a post's image size labels (label, position), the first of equals; none without labels."""
    rank = None
    for name, value in rules.SIZE_RANK.items():
        rank = F.when(F.col("label") == name, value) if rank is None else rank.when(F.col("label") == name, value)
    ranked = F.when(F.col("label").isNotNull(), F.struct(
        rank.otherwise(0).alias("rank"), (-F.col("position")).alias("first"), "label"))
    per = labels.groupBy(key).agg(F.max(ranked).alias("_best"))
    return per.select(key, F.coalesce("_best.label", F.lit("none")).alias("image_size_label"))
