"""Captured responses, files and chat logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from .. import schema as records
from ..functions.text import is_json, strip, suffix_of, truthy

_ENVELOPE = (
    "html string, finalUrl string, status string, cookies array<struct<name:string,value:string>>, userAgent string"
)


def parse_captures(df: DataFrame, raw: str = "raw", url: str = "url") -> DataFrame:
    """A1 on a table: a body that is a JSON envelope is opened, anything else is raw HTML with status 200."""
    text = F.col(raw)
    is_object = text.rlike(r"(?U)^\s*\{") & is_json(text)
    out = df.withColumn("_env", F.when(is_object, F.from_json(text, _ENVELOPE)))
    env = F.col("_env")
    status = F.coalesce(env["status"].try_cast("int"), F.lit(0))
    named = F.filter(env["cookies"], lambda c: c["name"].isNotNull())
    # Of cookies with one name the last counts.
    last = F.filter(named, lambda c, i: ~F.exists(
        F.slice(named, i + 2, F.size(named)), lambda later: later["name"] == c["name"]))
    return out.select(
        *[c for c in df.columns if c not in (raw, url)],
        F.col(url).alias("url"),
        F.coalesce(truthy(env["finalUrl"]), F.col(url)).alias("final_url"),
        F.when(status == 0, 200).otherwise(status).alias("status"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>")).alias("cookies"),
        F.when(env.isNull(), text).otherwise(F.coalesce(env["html"], F.lit(""))).alias("body"),
        truthy(env["userAgent"]).alias("user_agent"),
    )


def load_captures(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
                  raw: str = "raw", url: str = "url", schema: str | None = None) -> DataFrame:
    """A1: read captures, batch or as a stream.

    Formats: parquet, json, text with one envelope per line, or ``html``: every file is one capture, its path the URL.
    """
    if fmt == "html":
        reader = spark.readStream if streaming else spark.read
        pages = reader.text(path, wholetext=True)
        return parse_captures(pages.select(F.col("value").alias(raw), F.col("_metadata.file_path").alias(url)), raw, url)
    reader = spark.readStream if streaming else spark.read
    if schema:
        reader = reader.schema(schema)
    elif streaming and fmt != "text":
        reader = reader.schema(spark.read.format(fmt).load(path).schema)
    df = reader.format(fmt).load(path)
    if fmt == "text":
        df = df.select(F.col("value").alias(raw), F.lit("").alias(url))
    return parse_captures(df, raw, url)


def file_type_of(path: Column) -> Column:
    ext = suffix_of(path)
    return (
        F.when(ext.isin(rules.AUDIO_EXTS), "audio").when(ext.isin(rules.VIDEO_EXTS), "video")
        .when(ext.isin(rules.IMAGE_EXTS), "image").when(ext.isin(rules.TEXT_EXTS), "text")
        .when(ext.isin(rules.DOCUMENT_EXTS), "document").otherwise("unsupported")
    )


def describe_files(files: DataFrame, converted: str | None = None) -> DataFrame:
    """A2 on a (path, length, content) table.  ``converted`` names a column with a document's text, if there is one."""
    kind = file_type_of(F.col("path"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    is_document = F.col("file_type") == "document"
    document_text = F.col(converted) if converted else F.lit(None).cast("string")
    return files.withColumn("file_type", kind).select(
        F.col("path").alias("source"),
        F.lit("local").alias("platform"),
        "file_type",
        F.col("length").alias("size_bytes"),
        F.when(F.col("file_type") == "text", text).when(is_document, document_text).alias("body_text"),
        F.when(F.col("file_type").isin("video", "audio", "image"), F.array("path"))
        .otherwise(F.array().cast("array<string>")).alias("media_paths"),
        F.when(is_document, F.when(document_text.isNull(), "skipped_no_tool").otherwise("done"))
        .alias("conversion_label"),
        F.when(F.col("file_type") == "unsupported",
               F.concat(F.lit("unsupported_type:"), F.coalesce(truthy(suffix_of(F.col("path"))), F.lit("none"))))
        .alias("reject_reason"),
    )


def normalize_local(described: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """Described files (A2) to the normalized record; an unsupported file keeps its ``reject_reason``."""
    is_document = F.col("file_type") == "document"
    details = records.meta(
        fetched_at=F.lit(None) if fetched_at is None else fetched_at,
        extra={
            "file_type": F.col("file_type"), "size_bytes": F.col("size_bytes"),
            "conversion": F.when(is_document, "markitdown"), "conversion_label": F.col("conversion_label"),
        })
    return records.record(
        described, F.col("source"), "local", F.col("body_text"), details, media_paths=F.col("media_paths"), keep=["reject_reason"])


def inventory_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A2: one record per file.  Only text files are opened; of all others Spark reads the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    is_text = file_type_of(F.col("path")) == "text"
    opened = describe_files(files.filter(is_text).select("path", "length", "content"))
    listed = describe_files(
        files.filter(~is_text).select("path", "length").withColumn("content", F.lit(None).cast("binary")))
    return opened.unionByName(listed)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (path, line)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def count_chat(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Non-blank lines per ``path``; a path of ``files`` without readable lines counts 0."""
    counts = lines.groupBy("path").agg(F.count_if(strip("line") != "").alias("chat_message_count"))
    if files is None:
        return counts
    return files.select("path").distinct().join(counts, "path", "left").fillna(0, ["chat_message_count"])
