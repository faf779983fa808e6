"""Video platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules, schema
from ..functions import ordered
from ..functions.text import contains_any, strip, suffix_of, truthy, whole_json


def optional(df: DataFrame, name: str, default: Column) -> Column:
    """A column, or the default when the table has none or holds null."""
    return F.coalesce(F.col(name), default) if name in df.columns else default


def round6(x: Column) -> Column:
    """Round to six places by the exact binary value, ties to even.

    Only a product that is exactly odd can hide a tie; the sign of its rounding error (from splitting ``x`` into two
    halves whose products are exact) then tells on which side of the tie ``x`` lies.
    """
    scale = F.lit(2_000_000.0)
    product = x * scale
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    error = (high * scale - product) + (x - high) * scale
    odd = F.pmod(product, F.lit(2.0)) == 1.0
    up, down = (product + 1) / 2, (product - 1) / 2
    at_tie = F.when(error > 0, up).when(error < 0, down).otherwise(F.when(F.pmod(up, F.lit(2.0)) == 0, up).otherwise(down))
    return F.when(odd, at_tie).otherwise(F.floor(product / 2 + F.lit(0.5)).cast("double")) / F.lit(1_000_000.0)


def engagement_columns(views: Column, likes: Column, comments: Column) -> dict[str, Column]:
    rate = lambda n: F.when(views > 0, round6(F.coalesce(n, F.lit(0.0)) / views))
    label = F.when(views > 0, "computed").when(views == 0, "zero_views").otherwise("unavailable")
    return {"like_rate": rate(likes), "comment_rate": rate(comments), "engagement_label": label}


def engagement(df: DataFrame, views: str = "view_count", likes: str = "like_count",
               comments: str = "comment_count") -> DataFrame:
    """Like and comment rates per view; 0 views and missing views have different labels."""
    number = lambda c: F.col(c).try_cast("double")
    return df.withColumns(engagement_columns(number(views), number(likes), number(comments)))


def video_chat_labels(df: DataFrame) -> DataFrame:
    """``video_label`` and ``chat_label`` from the request flags and what was downloaded."""
    live = F.col("live_status")
    video = (
        F.when(~F.col("with_video"), "none")
        .when(~F.col("ok") | ~F.col("got_video"), "download_failed")
        .when(F.col("clipped"), "clipped")
        .when(F.col("from_start") & live.isin("is_live", "was_live", "post_live"), "downloaded_from_start")
        .otherwise("downloaded"))
    chat = (
        F.when(~F.col("with_chat"), "none")
        .when(F.col("chat_status") == "failed", "download_failed")
        .when(F.col("chat_path").isNotNull() & (F.col("chat_count") > 0),
              F.when(live == "is_live", "live_captured").otherwise("replay_full"))
        .otherwise("disabled"))
    return df.withColumn("video_label", video).withColumn("chat_label", chat)


_INFO = (
    "id string, title string, webpage_url string, channel string, channel_id string, uploader string, "
    "upload_date string, duration double, view_count string, like_count string, comment_count string, "
    "live_status string, was_live boolean, description string, subtitles map<string,string>, "
    "automatic_captions map<string,string>, chapters string, heatmap string"
)


def normalize_youtube(df: DataFrame, info: str = "info", fetched_at: Column | None = None) -> DataFrame:
    """Info JSON (plus source and optional download columns) to the normalized record."""
    parsed = df.withColumn("_i", F.from_json(F.col(info), _INFO))
    i = F.col("_i")
    count = lambda c: i[c].try_cast("double")
    rates = engagement_columns(count("view_count"), count("like_count"), count("comment_count"))
    languages = lambda c: F.coalesce(F.array_sort(F.map_keys(i[c])), schema.no_paths())
    listed = lambda a: F.to_json(a)
    no_json = F.lit("[]")
    details = schema.meta(
        title=i["title"],
        fetched_at=F.lit(None) if fetched_at is None else fetched_at,
        transcript_label=optional(df, "transcript_label", F.lit("none")),
        extra={
            **{c: i[c] for c in ("webpage_url", "channel", "channel_id", "uploader", "upload_date", "duration",
                                 "live_status", "was_live")},
            "video_id": i["id"],
            **{c: count(c).cast("long") for c in ("view_count", "like_count", "comment_count")},
            "from_start": optional(df, "from_start", F.lit(False)),
            "video_label": optional(df, "video_label", F.lit("none")),
            "subtitle_paths": listed(optional(df, "subtitle_paths", schema.no_paths())),
            "subtitle_langs": listed(languages("subtitles")),
            "auto_caption_available": F.size(languages("automatic_captions")) > 0,
            "auto_caption_langs": listed(languages("automatic_captions")),
            "chapters": F.coalesce(i["chapters"], no_json), "heatmap": F.coalesce(i["heatmap"], no_json),
            **rates,
            "live_chat_path": optional(df, "chat_path", F.lit(None).cast("string")),
            "chat_message_count": optional(df, "chat_count", F.lit(0)),
            "chat_label": optional(df, "chat_label", F.lit("none")),
            "comments_label": optional(df, "comments_label", F.lit("none")),
        })
    return schema.record(
        parsed, F.col("source"), "youtube", F.coalesce(i["description"], F.lit("")), details,
        comments=optional(df, "comments", schema.no_comments()),
        transcript=optional(df, "transcript", F.lit(None).cast("string")),
        media_paths=optional(df, "videos", schema.no_paths()))


def clean_transcript(segments: DataFrame, part_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """E5: (video_id, seq, text) segments to transcript text, repeated and blank lines left out.

    One row per video and run of ``part_rows`` segments; the parts of a video joined by line breaks are its
    transcript.  A video without any line has a null transcript and the label ``unavailable``.
    """
    line = strip(F.regexp_replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), r"[ \t]+", " "))
    lines = segments.select("video_id", "seq", line.alias("line"), F.floor(F.col("seq") / part_rows).alias("part_no"))
    spoken = lines.filter("line <> ''")
    # A dropped repeat equals the line kept before it, so the line before is always the one to compare with.
    compared = ordered.ordered_values(spoken, ["video_id"], ["seq"], "part_no", previous={"_before": F.col("line")})
    kept = compared.filter(~F.col("line").eqNullSafe(F.col("_before")))
    parts = kept.groupBy("video_id", "part_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("transcript"))
    videos = segments.select("video_id").distinct()
    return videos.join(parts, "video_id", "left").select(
        "video_id", F.coalesce("part_no", F.lit(0)).alias("part_no"), "transcript",
        F.when(F.col("transcript").isNull(), "unavailable").otherwise("fetched").alias("transcript_label"))


def top_comments(comments: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` comments per video in popularity order (``seq``), and an honest label.

    Columns: video_id, seq, author, text, votes, time, heart, reply, is_error.  An error row ends the list; it only
    counts when reading got that far.
    """
    videos = comments.select("video_id").distinct()
    if limit <= 0:
        return videos.select(
            "video_id", schema.no_comments().alias("comments"), F.lit("fetched").alias("comments_label"))
    w = W.partitionBy("video_id").orderBy("seq")
    read = comments.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit + 1)
    failed = F.coalesce(F.col("is_error"), F.lit(False))
    votes = F.col("votes").try_cast("long")
    comment = schema.comment(
        author=F.col("author"), text=F.col("text"), likes=votes, hearted=F.coalesce("heart", F.lit(False)),
        is_reply=F.coalesce("reply", F.lit(False)))
    per = read.groupBy("video_id").agg(
        F.min(F.when(failed, F.col("_rank"))).alias("_broke"),
        F.array_sort(F.collect_list(F.when(~failed, F.struct("_rank", comment.alias("c"))))).alias("_cs"))
    kept = F.filter("_cs", lambda x: (x["_rank"] <= limit) & (F.col("_broke").isNull() | (x["_rank"] < F.col("_broke"))))
    return per.select(
        "video_id", F.transform(kept, lambda x: x["c"]).alias("comments"),
        F.when(F.col("_broke").isNotNull(), "fetch_failed").otherwise("fetched").alias("comments_label"))


def collect_outputs(files: DataFrame) -> DataFrame:
    """Output files of a video with their ``kind`` (video, subtitle), unfinished files and chat logs left out.

    Rows, not arrays: the path orders the files of a video, and no video's file list has to fit one row.
    """
    name = F.lower("path")
    kind = F.when(suffix_of(name).isin(rules.SUBTITLE_EXTS), "subtitle").otherwise("video")
    skip = suffix_of(name).isin(rules.UNFINISHED_EXTS) | name.endswith(".live_chat.json")
    return files.filter(~skip).select("video_id", kind.alias("kind"), "path")


def assemble_videos(infos: DataFrame, outputs: DataFrame | None = None, transcripts: DataFrame | None = None,
                    comments: DataFrame | None = None, chats: DataFrame | None = None) -> DataFrame:
    """What the other steps found for each video (``video_id``), as the columns :func:`normalize_youtube` reads.

    ``outputs`` (E7): video_id, kind, path.  ``transcripts`` (E5): parts, put together in order.  ``comments`` (E6).
    ``chats`` (E4): video_id, chat_message_count, optional chat_path.  Labels of E3 are columns of ``infos`` already.
    """
    out = infos
    if outputs is not None:
        paths = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("path"))))
        out = out.join(outputs.groupBy("video_id").agg(
            paths("video").alias("videos"), paths("subtitle").alias("subtitle_paths")), "video_id", "left")
        out = out.withColumns({c: F.coalesce(c, schema.no_paths()) for c in ("videos", "subtitle_paths")})
    if transcripts is not None:
        parts = F.array_sort(F.collect_list(F.when(F.col("transcript").isNotNull(), F.struct("part_no", "transcript"))))
        whole = transcripts.groupBy("video_id").agg(parts.alias("_parts"))
        out = out.join(whole, "video_id", "left").withColumns({
            "transcript": F.when(F.size("_parts") > 0, F.array_join(F.transform("_parts", lambda p: p["transcript"]), "\n")),
            "transcript_label": F.when(F.size("_parts") > 0, "fetched").when(F.col("_parts").isNotNull(), "unavailable").otherwise("none"),
        }).drop("_parts")
    if comments is not None:
        out = out.join(comments.select("video_id", "comments", "comments_label"), "video_id", "left").withColumns({
            "comments": F.coalesce("comments", schema.no_comments()), "comments_label": F.coalesce("comments_label", F.lit("none"))})
    if chats is not None:
        found = chats.select("video_id", F.col("chat_message_count").alias("chat_count"), *[
            c for c in chats.columns if c == "chat_path"])
        out = out.join(found, "video_id", "left").withColumn("chat_count", F.coalesce("chat_count", F.lit(0)))
    return out


def normalize_tiktok(df: DataFrame, dump: str = "dump", fetched_at: Column | None = None) -> DataFrame:
    """``[[kind, payload], ...]`` dumps to records; a dump without a payload object gets a ``reject_reason``.

    Optional columns: media_paths, downloaded.
    """
    entries = F.try_variant_get(F.try_parse_json(whole_json(dump)), "$", "array<variant>")
    payloads = F.filter(
        F.transform(entries, lambda e: F.try_variant_get(e, "$[1]", "variant")),
        lambda p: F.try_variant_get(p, "$", "map<string,variant>").isNotNull())
    # Columns of their own, so that a dump is read once.
    listed = df.withColumn("_ps", payloads)
    described = F.filter("_ps", lambda p: F.try_variant_get(p, "$.desc", "string").isNotNull())
    found = F.coalesce(F.get(described, F.lit(0)), F.get("_ps", F.lit(0)))
    picked = listed.withColumn("_p", found)
    p = F.col("_p")
    text = lambda path: F.try_variant_get(p, path, "string")

    def stat(name: str) -> Column:
        absent = F.try_variant_get(p, f"$.stats.{name}", "variant").isNull()
        return F.when(absent, F.lit(0)).otherwise(F.try_variant_get(p, f"$.stats.{name}", "bigint"))

    seconds = text("$.createTime").try_cast("double")
    # Years 1 to 9999 are what a timestamp can hold.
    in_range = seconds.between(-62135596800, 253402300799)
    created = F.when(in_range, F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))
    paths = optional(df, "media_paths", schema.no_paths())
    wanted = optional(df, "downloaded", F.lit(False))
    label = F.when(~wanted, "none").when(F.size(paths) > 0, "downloaded").otherwise("download_failed")
    details = schema.meta(
        author=F.coalesce(truthy(text("$.author.uniqueId")), text("$.author.nickname")),
        fetched_at=F.lit(None) if fetched_at is None else fetched_at,
        extra={
            "video_id": text("$.id"),
            "author_verified": F.coalesce(F.try_variant_get(p, "$.author.verified", "boolean"), F.lit(False)),
            "digg_count": stat("diggCount"), "comment_count": stat("commentCount"), "play_count": stat("playCount"),
            "share_count": stat("shareCount"), "duration_sec": text("$.video.duration"), "media_label": label,
            "created_at_utc": F.date_format(created, "yyyy-MM-dd'T'HH:mm:ssXXX"),
        })
    records = schema.record(
        picked.withColumn("reject_reason", F.when(p.isNull(), "no payload object")), F.col("source"), "tiktok",
        F.coalesce(text("$.desc"), F.lit("")), details, media_paths=paths, keep=["reject_reason"])
    return records
