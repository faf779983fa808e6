"""The normalized record: eight fields, the last one typed per platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT = (
    "struct<id:string,code:string,author:string,text:string,likes:bigint,reply_count:bigint,"
    "created_at:timestamp,is_reply:boolean,hearted:boolean,media_paths:array<string>>"
)
OCR_TEXT = "struct<media_path:string,text:string,model:string>"
ENVELOPE = ["source", "platform", "body_text", "comments", "ocr_text", "transcript", "media_paths", "meta"]
# What rendering, completeness and enrichment read from ``meta``; everything else stays in ``meta.extra``.
META = (
    "struct<author:string,code:string,title:string,likes:bigint,reply_count:bigint,comment_count_captured:bigint,"
    "media_complete:boolean,completeness:struct<root_found:boolean,expected:bigint,captured:bigint,"
    "incomplete:boolean,scrape_mode:string,max_pages:int>,fetched_at:timestamp,ocr_label:string,"
    "ocr_provider:string,transcript_label:string,transcript_model:string,transcript_backend:string,"
    "transcript_sources:array<string>,extra:map<string,string>>"
)


def comment(**fields: Column) -> Column:
    """A comment in the unified shape; absent fields are null."""
    names = [f.split(":", 1)[0] for f in (
        "id:string", "code:string", "author:string", "text:string", "likes:bigint", "reply_count:bigint",
        "created_at:timestamp", "is_reply:boolean", "hearted:boolean", "media_paths:array")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(COMMENT)


def no_comments() -> Column:
    return F.array().cast(f"array<{COMMENT}>")


def no_ocr() -> Column:
    return F.array().cast(f"array<{OCR_TEXT}>")


def no_paths() -> Column:
    return F.array().cast("array<string>")


def text_map(fields: dict[str, Column]) -> Column:
    """Platform fields as text, null entries left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def meta(extra: dict[str, Column] | None = None, **fields: Column) -> Column:
    """The ``meta`` struct: named fields, and the platform's own fields in ``extra``."""
    names = [
        "author", "code", "title", "likes", "reply_count", "comment_count_captured", "media_complete", "completeness",
        "fetched_at", "ocr_label", "ocr_provider", "transcript_label", "transcript_model", "transcript_backend",
        "transcript_sources",
    ]
    values = [fields.get(n, F.lit(None)).alias(n) for n in names]
    rest = text_map(extra) if extra else F.create_map().cast("map<string,string>")
    return F.struct(*values, rest.alias("extra")).cast(META)


def record(
    df: DataFrame,
    source: Column,
    platform: str,
    body_text: Column,
    meta: Column,
    comments: Column | None = None,
    transcript: Column | None = None,
    media_paths: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Project to the envelope (plus the ``keep`` columns in front).

    ``part_no`` and ``part_count`` are never null: a record in one part is part 0 of 1.
    """
    parts = [F.lit(v).alias(c) for c, v in (("part_no", 0), ("part_count", 1)) if c not in (keep or [])]
    return df.select(
        *(keep or []),
        source.alias("source"),
        F.lit(platform).alias("platform"),
        body_text.cast("string").alias("body_text"),
        (no_comments() if comments is None else comments).alias("comments"),
        no_ocr().alias("ocr_text"),
        (F.lit(None) if transcript is None else transcript).cast("string").alias("transcript"),
        F.coalesce(no_paths() if media_paths is None else media_paths, no_paths()).alias("media_paths"),
        meta.alias("meta"),
        *parts,
    )
