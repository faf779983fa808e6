"""Threaded posts (D1-D10): extraction from payloads, merging, completeness, crawl closure, assembly.

A thread or crawl may hold a third of all posts.  Values per thread are combined aggregates; lists are built per
part of bounded length, and a thread with more posts than ``part_size`` becomes several rows that together hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules, schema
from ..functions import ordered
from ..functions.jsonwalk import objects_under
from ..functions.lineage import bucketed, cut
from ..functions.text import truthy
from ..functions.workers import ship

PART_SIZE = 10000
# Text of posts that a worker hands on at once.
WALK_CHARS = 4 << 20
# Levels of a crawl after which visited pages are put together.
MERGE_LEVELS = 8


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def iter_thread_posts(payloads: DataFrame, blocked_keys: list[str] | None = None, payload: str = "payload",
                      keys: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Every object under a key ``post`` at any depth, outside the ``blocked_keys`` subtrees.

    ``payload`` is JSON text or VARIANT; one that is not valid JSON has no posts.  Payloads are read once, whatever their
    depth, and not shuffled.  ``path`` (positions from the top) orders the posts of a payload as its text does, enclosing
    posts first; a VARIANT has its keys sorted, so only text keeps the order of siblings.  With ``max_depth`` a deeper
    payload adds a row with ``reject_reason``.
    """
    ship(payloads.sparkSession)
    keys = keys or [c for c in payloads.columns if c != payload]
    blocked = blocked_keys if blocked_keys is not None else rules.RELATED_KEYS
    text = F.to_json(payload) if isinstance(payloads.schema[payload].dataType, T.VariantType) else F.when(
        F.try_parse_json(payload).isNotNull(), F.col(payload))
    # Scalars hold nothing, and most texts without the key need no walk.
    rows = payloads.select(*keys, text.alias("_text")).filter(F.col("_text").contains('post"') | F.col("_text").contains("\\") | F.lit(max_depth is not None))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at = 0, []
            out: list[tuple[list[int], str, str | None]] = []
            for r in range(batch.num_rows):
                posts, deeper = objects_under(batch.column(len(keys))[r].as_py() or "", "post", blocked, max_depth)
                found = [(list(p), body, None) for p, body in posts] + ([([], "null", "too_deep")] if deeper else [])
                at += [r] * len(found)
                out += found
                held += sum(len(f[1]) for f in found)
                if held > WALK_CHARS or r == batch.num_rows - 1:
                    paths, bodies, reasons = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
                    place = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(place) for c in batch.columns[: len(keys)]), pa.array(paths, pa.list_(pa.int32())),
                         pa.array(bodies, pa.string()), pa.array(reasons, pa.string())], [*keys, "path", "_post", "reject_reason"])
                    held, at, out = 0, [], []

    found = rows.mapInArrow(walk, f"{kinds}, path array<int>, _post string, reject_reason string")
    return found.select(*keys, "path", F.parse_json("_post").alias("post"), "reject_reason")


def _best_url(candidates: Column) -> Column:
    """URL of the widest candidate, the last one of equals; a candidate without URL does not count."""
    ranked = F.transform(candidates, lambda c, i: F.struct(
        F.coalesce(c["width"], F.lit(0.0)).alias("w"), i.alias("i"), c["url"].alias("url")))
    return F.array_max(F.filter(ranked, lambda c: truthy(c["url"]).isNotNull() & (c["w"] >= -1)))["url"]


_CANDIDATES = "array<struct<url:string,width:double>>"


def post_media(post: Column) -> tuple[Column, Column]:
    """(images, videos) of a post; carousel items stand for their parent, a video hides its cover image."""
    carousel = F.try_variant_get(post, "$.carousel_media", "array<variant>")
    nodes = F.when(F.size(carousel) > 0, carousel).otherwise(F.array(post))

    def pick(node: Column) -> Column:
        videos = F.try_variant_get(node, "$.video_versions", _CANDIDATES)
        images = F.try_variant_get(node, "$.image_versions2.candidates", _CANDIDATES)
        is_video = F.coalesce(F.size(videos) > 0, F.lit(False))
        return F.struct(
            is_video.alias("video"), F.when(is_video, _best_url(videos)).otherwise(_best_url(images)).alias("url"))

    picked = F.filter(F.transform(nodes, pick), lambda m: m["url"].isNotNull())
    of_kind = lambda video: F.array_distinct(F.transform(
        F.filter(picked, lambda m: m["video"] == F.lit(video)), lambda m: m["url"]))
    return of_kind(False), of_kind(True)


def select_media(posts: DataFrame, post: str = "post") -> DataFrame:
    """D3: ``images`` and ``videos`` of a VARIANT post."""
    images, videos = post_media(F.col(post))
    return posts.withColumns({"images": images, "videos": videos})


def parse_posts(posts: DataFrame, post: str = "post") -> DataFrame:
    """VARIANT posts to columns.  Posts without author, or without text and media, are dropped; so are posts
    whose ``text_post_app_info`` is an explicit null."""
    p = F.col(post)

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(p, path, kind)

    def or_zero(path: str) -> Column:
        absent = F.try_variant_get(p, path, "variant").isNull()
        return F.when(absent, F.lit(0)).otherwise(get(path, "bigint"))

    info = F.try_variant_get(p, "$.text_post_app_info", "variant")
    info_ok = info.isNull() | F.coalesce(_is_object(info), F.lit(False))
    with_media = select_media(posts, post)
    return (
        with_media.withColumns({
            "id": get("$.id"), "code": get("$.code"), "text": get("$.caption.text"), "author": get("$.user.username"),
            "likes": or_zero("$.like_count"),
            "reply_count": or_zero("$.text_post_app_info.direct_reply_count"),
            "taken_at": get("$.taken_at", "bigint"), "_info_ok": info_ok,
        })
        .filter(
            F.col("_info_ok") & truthy("author").isNotNull()
            & (truthy("text").isNotNull() | (F.size("images") > 0) | (F.size("videos") > 0)))
        .drop("_info_ok", post)
    )


def merge_posts(posts: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per id: the last value, at the position of the first sighting (``first_seq``)."""
    keys, order = keys or ["thread_id"], order or ["seq"]
    rest = [c for c in posts.columns if c not in (*keys, "id")]
    at = F.struct(*order)
    per = posts.filter("id is not null").groupBy(*keys, "id").agg(
        F.max_by(F.struct(*rest), at).alias("_last"), F.min(at).alias("_first"))
    first = F.col("_first")
    return per.select(
        *keys, "id", *[F.col("_last")[c].alias(c) for c in rest],
        (first[order[0]] if len(order) == 1 else first).alias("first_seq"))


def assess_completeness(posts: DataFrame) -> DataFrame:
    """Per thread: was the root found, how many replies it announces, how many were captured.

    Needs thread_id, root_code, seq, code, reply_count.
    """
    is_root = F.coalesce(F.col("code") == F.col("root_code"), F.lit(False))
    per = posts.groupBy("thread_id").agg(
        F.min(F.when(is_root, F.struct("seq", "reply_count"))).alias("root"), F.count_if(~is_root).alias("captured"))
    found = F.col("root").isNotNull()
    return per.select(
        "thread_id", found.alias("root_found"),
        F.when(found, F.col("root.reply_count")).otherwise(0).cast("long").alias("expected"), "captured",
        (found & (F.col("captured") < F.coalesce("root.reply_count", F.lit(0)))).alias("incomplete"))


def post_url(author: Column, code: Column) -> Column:
    return F.concat(F.lit("https://www.threads.net/@"), author, F.lit("/post/"), code)


def expand_frontier(posts: DataFrame, visited: DataFrame, max_pages: int | None = None,
                    order: list[str] | None = None) -> DataFrame:
    """Next pages per ``crawl_id`` in first-seen order; ``max_pages`` keeps as many as a page budget leaves.

    ``posts``: crawl_id, author, code, reply_count and the ``order`` columns; ``visited``: crawl_id, url.
    """
    used = None if max_pages is None else visited.groupBy("crawl_id").agg(F.count("*").alias("_used"))
    return _ranked(_unseen(_leads(posts, order or ["seq"]), [visited]), max_pages, used)


def _leads(posts: DataFrame, order: list[str]) -> DataFrame:
    """crawl_id, url, found_at: the pages posts with replies lead to, at their first sighting."""
    leads = posts.filter((F.col("reply_count") > 0) & truthy("code").isNotNull()).select(
        "crawl_id", post_url(F.col("author"), F.col("code")).alias("url"), F.struct(*order).alias("found_at"))
    return leads.groupBy("crawl_id", "url").agg(F.min("found_at").alias("found_at"))


def _unseen(leads: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """Leads in none of the tables ``seen``; tables in buckets of (crawl_id, url) are read where they lie."""
    return reduce(lambda rest, table: rest.join(table.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti"), seen, leads)


def _ranked(fresh: DataFrame, max_pages: int | None, used: DataFrame | None) -> DataFrame:
    """crawl_id, url, visit_no, found_at, as many as the page budget leaves."""
    best = fresh if max_pages is None else ordered.first_by(fresh, ["crawl_id"], ["found_at", "url"], max_pages)
    ranked = best.withColumn("visit_no", F.row_number().over(_by_crawl()))
    if max_pages is None:
        return ranked.select("crawl_id", "url", "visit_no", "found_at")
    left = F.lit(max_pages) - F.coalesce("_used", F.lit(0))
    ranked = ranked.join(used, "crawl_id", "left")
    return ranked.filter(F.col("visit_no") <= left).select("crawl_id", "url", "visit_no", "found_at")


def _by_crawl():
    from pyspark.sql import Window as W

    return W.partitionBy("crawl_id").orderBy("found_at", "url")


def crawl_reach(starts: DataFrame, page_posts: DataFrame, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first closure over captured pages.

    ``starts``: crawl_id, url.  ``page_posts``: page_url, seq, id, author, code, reply_count and more.  Returns the
    merged posts per crawl and (crawl_id, visited_pages, budget_hit).  Each round opens one level and is written down;
    a level visits pages in the order a first-in-first-out queue would, so a page budget (``max_pages``) cuts at the
    same page, and ``budget_hit`` tells that it was used up.

    A round shuffles what the new level leads to and no more: links lie in buckets of their page, visited pages in
    buckets of crawl and page, level by level, ``MERGE_LEVELS`` of them put together when there are as many.
    """
    on = ["crawl_id", "url"]
    level = bucketed(starts.select(*on).distinct().withColumns({"depth": F.lit(0), "visit_no": F.lit(1)}), "visited", *on)
    levels, seen = [level], [level]
    # What a page leads to; posts in full are joined once, at the end.
    links = bucketed(page_posts.filter((F.col("reply_count") > 0) & truthy("code").isNotNull()).select(
        F.col("page_url").alias("url"), "seq", "author", "code", "reply_count"), "links", "url")
    used = None if max_pages is None else cut(level.groupBy("crawl_id").agg(F.count("*").alias("_used")))
    for depth in count(1):
        # A page many crawls are at is spread; its links are few.
        needed = links.join(level.select("url").distinct(), "url", "left_semi")
        opened = ordered.lookup(level.select("crawl_id", "visit_no", "url"), needed, ["url"]).filter("code is not null")
        fresh = _unseen(_leads(opened, ["visit_no", "seq"]), seen)
        found = _ranked(fresh, max_pages, used).select(*on, F.lit(depth).alias("depth"), "visit_no")
        level = bucketed(found, "visited", *on)
        if level.isEmpty():
            break
        levels.append(level)
        seen.append(level)
        if len(seen) >= MERGE_LEVELS:
            seen = [bucketed(reduce(DataFrame.unionByName, [s.select(*on) for s in seen]), "visited", *on)]
        if used is not None:
            more = level.groupBy("crawl_id").agg(F.count("*").alias("_used"))
            used = cut(used.unionByName(more).groupBy("crawl_id").agg(F.sum("_used").alias("_used")))
    visited = reduce(DataFrame.unionByName, levels)
    seen_posts = visited.join(page_posts, F.col("url") == F.col("page_url")).drop("url", "page_url")
    merged = merge_posts(seen_posts, ["crawl_id"], ["depth", "visit_no", "seq"]).drop("depth", "visit_no", "seq")
    pages = visited.groupBy("crawl_id").agg(F.count("*").alias("visited_pages"))
    return merged, pages.withColumn(
        "budget_hit", F.lit(False) if max_pages is None else F.col("visited_pages") >= max_pages)


def escalate(fast: DataFrame, deep: DataFrame) -> DataFrame:
    """Per thread the fast posts, or the deep ones where the fast capture is incomplete and a deep one exists.

    Both sides carry the same columns; ``scrape_mode`` says which was taken.
    """
    incomplete = assess_completeness(fast).filter("incomplete").select("thread_id")
    switch = deep.select("thread_id").distinct().join(incomplete, "thread_id", "left_semi").withColumn(
        "_deep", F.lit(True))
    kept = ordered.lookup(fast, switch, ["thread_id"]).filter("_deep is null")
    taken = ordered.lookup(deep, switch, ["thread_id"]).filter("_deep")
    return kept.drop("_deep").withColumn("scrape_mode", F.lit("fast")).unionByName(
        taken.drop("_deep").withColumn("scrape_mode", F.lit("deep")))


def thread_media_label(total: Column, got: Column, downloaded: Column) -> Column:
    return (
        F.when(~downloaded | (total == 0), "none").when(got == 0, "download_failed")
        .when(got < total, "partially_downloaded").otherwise("downloaded"))


def media_label(posts: DataFrame, downloaded: bool | Column, platform: str = "threads",
                key: str = "thread_id") -> DataFrame:
    """``media_label`` and ``media_complete`` per thread; single-file platforms know no partial download.

    Needs array columns images, videos and downloaded.
    """
    wanted = F.lit(downloaded) if isinstance(downloaded, bool) else downloaded
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    per = posts.groupBy(key).agg(
        F.sum(size("images") + size("videos")).alias("total"), F.sum(size("downloaded")).alias("got"))
    total, got = F.col("total"), F.col("got")
    if platform == "threads":
        label = thread_media_label(total, got, wanted)
    else:
        label = F.when(~wanted, "none").when(got > 0, "downloaded").otherwise("download_failed")
    return per.select(key, label.alias("media_label"), ((got == total) & (total > 0)).alias("media_complete"))


def assemble_threads(posts: DataFrame, downloaded: bool = False, part_size: int = PART_SIZE,
                     scrape_mode: str = "fast", fetched_at: Column | None = None,
                     max_pages: Column | None = None) -> DataFrame:
    """Threads to normalized records.

    A column ``scrape_mode`` of ``posts`` (as D8 adds it) tells how each thread was read; ``max_pages`` is the page
    budget of its crawl.

    ``posts``: thread_id, source, root_code, seq, id, code, author, text, likes, reply_count, images, videos,
    downloaded.  Adds part_no and part_count; ``comments`` and ``media_paths`` of a thread's parts, in order, are
    its whole lists.  A thread without root is one row with ``reject_reason``.
    """
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    is_root = F.coalesce(F.col("code") == F.col("root_code"), F.lit(False))
    numbered = ordered.ordered_values(
        posts.withColumn("_root", is_root), ["thread_id"], ["seq"], ordered.chunk_of("seq"),
        running={"_n": F.lit(1)})
    numbered = numbered.withColumn("part_no", F.floor((F.col("_n") - 1) / part_size).cast("int"))
    comment = schema.comment(
        id=F.col("id"), code=F.col("code"), author=F.col("author"), text=F.coalesce("text", F.lit("")),
        likes=F.col("likes"), reply_count=F.col("reply_count"),
        media_paths=F.coalesce("downloaded", schema.no_paths()))
    parts = numbered.groupBy("thread_id", "part_no").agg(
        F.array_sort(F.collect_list(F.when(~F.col("_root"), F.struct("_n", comment.alias("c"))))).alias("_cs"),
        F.array_sort(F.collect_list(F.when(size("downloaded") > 0, F.struct("_n", "downloaded")))).alias("_ms"))
    heads = posts.withColumn("_root", is_root).groupBy("thread_id").agg(
        F.max("source").alias("source"),
        F.max("root_code").alias("root_code"),
        F.max(F.col("scrape_mode") if "scrape_mode" in posts.columns else F.lit(scrape_mode)).alias("scrape_mode"),
        F.max(F.lit(None) if max_pages is None else max_pages).cast("int").alias("max_pages"),
        F.min(F.when(F.col("_root"), F.struct("seq", "id", "author", "text", "likes", "reply_count"))).alias("root"),
        F.count_if(~F.col("_root")).alias("captured"), F.count("*").alias("n"),
        F.sum(size("images")).alias("image_count"), F.sum(size("videos")).alias("video_count"),
        F.sum(size("downloaded")).alias("got"))
    whole = ordered.lookup(parts, heads, ["thread_id"])
    root, total = F.col("root"), F.col("image_count") + F.col("video_count")
    found = root.isNotNull()
    expected = F.coalesce(root["reply_count"], F.lit(0))
    details = schema.meta(
        author=root["author"], code=F.col("root_code"), likes=root["likes"], reply_count=root["reply_count"],
        comment_count_captured=F.col("captured"), media_complete=(F.col("got") == total) & (total > 0),
        completeness=F.struct(
            found.alias("root_found"), expected.cast("long").alias("expected"), F.col("captured").alias("captured"),
            (F.col("captured") < expected).alias("incomplete"), "scrape_mode", "max_pages"),
        fetched_at=F.lit(None) if fetched_at is None else fetched_at,
        extra={
            "post_id": root["id"], "local_media_count": F.col("got"), "image_count": F.col("image_count"), "video_count": F.col("video_count"),
            "media_label": thread_media_label(total, F.col("got"), F.lit(downloaded)),
        })
    whole = whole.withColumn("part_count", F.ceil(F.col("n") / part_size).cast("int")).filter(
        found | (F.col("part_no") == 0))
    records = schema.record(
        whole.withColumn("reject_reason", F.when(~found, "root not found")),
        F.col("source"), "threads", F.coalesce(root["text"], F.lit("")), details,
        comments=F.transform("_cs", lambda c: c["c"]),
        media_paths=F.flatten(F.transform("_ms", lambda m: m["downloaded"])),
        keep=["thread_id", "part_no", "part_count", "reject_reason"])
    # The text belongs to the first part.
    first = F.col("part_no") == 0
    return records.withColumn("body_text", F.when(first, F.col("body_text")).otherwise(""))
