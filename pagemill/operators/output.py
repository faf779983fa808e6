"""Rendering and writing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import file_system
from ..functions.text import join_lines, truthy
from ..functions.workers import setting

# Headings and labels of the rendered document.
POST_WORD = "포스트"
COMMENTS_HEAD, MEDIA_HEAD, OCR_HEAD, TRANSCRIPT_HEAD = "댓글", "## 미디어", "## 이미지 속 텍스트 (OCR)", "## 전사"
COLLECTED, OF_ALL, ANONYMOUS, UNKNOWN_FILE = "개 수집", "전체 ~", "(익명)", "(알 수 없는 파일)"
PLATFORM_WORD, LIKES_WORD, FETCHED_WORD, COMPLETE_WORD = "플랫폼", "좋아요", "수집", "완전성"
COMPLETE, INCOMPLETE, MEDIA_MISSING = "완전수집", "부분수집", " · 미디어 일부 누락"
# Platforms whose comments carry a like count the rendering shows.
LIKES_SHOWN = ["threads", "facebook"]


def completeness_text(meta: Column) -> Column:
    c = meta["completeness"]
    shown = F.when(F.coalesce(c["incomplete"], F.lit(False)), F.concat(
        F.lit(f"{INCOMPLETE}("), F.coalesce(c["captured"].cast("string"), F.lit("None")), F.lit("/"),
        F.coalesce(c["expected"].cast("string"), F.lit("None")), F.lit(")"))).otherwise(COMPLETE)
    missing = F.when(~F.coalesce(meta["media_complete"], F.lit(True)), MEDIA_MISSING).otherwise("")
    return F.concat(shown, missing)


def completeness_label(df: DataFrame, meta: str = "meta") -> DataFrame:
    """How complete a record is, in words."""
    return df.withColumn("completeness_label", completeness_text(F.col(meta)))


def _normal_segments(path: Column) -> Column:
    """Segments of an absolute path, dot segments and doubled slashes resolved."""
    return F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, s: F.when(s.isin("", "."), done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, s)))


def shown_path(path: Column, path_mode: str, relative_to: str | None, base_dir: str) -> Column:
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), path))
    segments = _normal_segments(full)
    if path_mode == "absolute":
        return F.concat(F.lit("/"), F.array_join(segments, "/"))
    if path_mode != "relative" or relative_to is None:
        raise ValueError("path_mode is absolute, or relative with relative_to")
    start = F.lit([s for s in relative_to.split("/") if s not in ("", ".")])
    places = F.sequence(F.lit(0), F.size(start))
    common = F.array_min(F.filter(
        places, lambda i: ~F.coalesce(F.get(start, i) == F.get(segments, i), F.lit(False))))
    up = F.array_repeat(F.lit(".."), F.size(start) - common)
    relative = F.array_join(F.concat(up, F.slice(segments, common + 1, F.size(segments))), "/")
    return F.coalesce(truthy(relative), F.lit("."))


def _iso(ts: Column) -> Column:
    whole = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def _fold(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))


def _section(head: Column, lines: Column, shown: Column) -> Column:
    """A blank line, the heading, a blank line and the lines; nothing when there are none."""
    return F.when(shown, F.concat(F.array(F.lit(""), head, F.lit("")), lines)).otherwise(
        F.array().cast("array<string>"))


def render_markdown(docs: DataFrame, path_mode: str = "absolute", relative_to: str | None = None,
                    base_dir: str = "/", keys: list[str] | None = None) -> DataFrame:
    """G1: records to Markdown: the ``keys``, section, part_no and markdown.

    A record in one part is one row (section 1, part 0).  One in several parts (``part_no``, ``part_count``) gives
    rows of sections; a document is its rows' texts in (section, part_no) order, joined by nothing.  Records that say
    nothing about parts have one.
    """
    meta, platform = F.col("meta"), F.coalesce(truthy("platform"), F.lit("unknown"))
    docs = docs.withColumns({
        c: F.coalesce(F.col(c) if c in docs.columns else F.lit(None), F.lit(v)).cast("int")
        for c, v in (("part_no", 0), ("part_count", 1))})
    first, last = F.col("part_no") == 0, F.col("part_no") == F.col("part_count") - 1
    keys = keys or [c for c in ("source", "platform") if c in docs.columns]

    author = truthy(meta["author"])
    code = F.coalesce(truthy(meta["code"]), truthy("source"), F.lit(""))
    title = F.concat(
        F.lit("# "), F.coalesce(F.concat(F.lit("@"), author, F.lit(" — ")), F.lit("")), platform,
        F.lit(f" {POST_WORD} ("), code, F.lit(")"))
    body = F.when(truthy("body_text").isNotNull(), F.array(F.lit(""), F.col("body_text"))).otherwise(
        F.array().cast("array<string>"))

    comments = F.col("comments")
    n = F.when(F.col("part_count") > 1, meta["comment_count_captured"]).otherwise(F.size(comments).cast("long"))
    n = F.coalesce(n, F.size(comments).cast("long"))
    total = F.coalesce(meta["completeness"]["expected"], meta["reply_count"])
    head = F.concat(
        F.lit(f"## {COMMENTS_HEAD} ("), n.cast("string"), F.lit(COLLECTED),
        F.coalesce(F.concat(F.lit(f" / {OF_ALL}"), total.cast("string")), F.lit("")), F.lit(")"))
    likes_shown = platform.isin(LIKES_SHOWN)
    bullets = F.transform(comments, lambda c: F.concat(
        F.lit("- **"), F.coalesce(truthy(c["author"]), F.lit(ANONYMOUS)), F.lit("**"),
        F.when(likes_shown & c["likes"].isNotNull(), F.concat(F.lit(" ♥"), c["likes"].cast("string"))).otherwise(""),
        F.lit(": "), _fold(c["text"])))

    paths = F.col("media_paths")
    media_lines = F.transform(
        paths, lambda p: F.concat(F.lit("- "), shown_path(p, path_mode, relative_to, base_dir)))
    ocr_lines = F.transform("ocr_text", lambda o: F.concat(
        F.lit("> "), F.coalesce(truthy(F.substring_index(F.regexp_replace(
            F.coalesce(o["media_path"], F.lit("")), "/+$", ""), "/", -1)), F.lit(UNKNOWN_FILE)),
        F.lit(": "), _fold(o["text"])))
    transcript = F.when(truthy("transcript").isNotNull(), F.array(
        F.lit(""), F.lit(TRANSCRIPT_HEAD), F.lit(""), F.col("transcript"))).otherwise(F.array().cast("array<string>"))
    footer = F.array(F.lit(""), F.concat(F.lit("---\n"), F.concat_ws(
        " · ",
        F.concat(F.lit(f"{PLATFORM_WORD}: "), platform),
        F.concat(F.lit(f"{LIKES_WORD}: "), meta["likes"].cast("string")),
        F.concat(F.lit(f"{FETCHED_WORD}: "), _iso(meta["fetched_at"])),
        F.concat(F.lit(f"{COMPLETE_WORD}: "), completeness_text(meta)))))

    none = F.array().cast("array<string>")
    when = lambda cond, lines: F.when(cond, lines).otherwise(none)
    size = F.size(paths).cast("long")
    saved = F.when(F.col("part_count") > 1, F.coalesce(
        F.try_element_at(meta["extra"], F.lit("local_media_count")).try_cast("long"), size)).otherwise(size)
    open_comments = when(first & (n > 0), F.array(F.lit(""), head, F.lit("")))
    open_media = when(first & (saved > 0), F.array(F.lit(""), F.lit(MEDIA_HEAD), F.lit("")))
    ocr = _section(F.lit(OCR_HEAD), ocr_lines, F.size("ocr_text") > 0)
    opening = F.concat(when(first, F.concat(F.array(title), body)), open_comments, bullets)
    # Columns of their own: each is worked out once, by generated code where Spark has it.
    docs = docs.select(*keys, "part_no", "part_count", opening.alias("_opening"), F.concat(open_media, media_lines).alias("_media"),
                       ocr.alias("_ocr"), F.concat(transcript, when(last, footer)).alias("_closing"))
    named = ["_opening", "_media", "_ocr", "_closing"]
    section = lambda i, lines: F.struct(F.lit(i).alias("section"), lines.alias("lines"))
    chosen = F.when(F.col("part_count") == 1, F.array(section(1, F.concat(*named)))).otherwise(
        F.array(*[section(i, F.col(c)) for i, c in enumerate(named, 1)]))
    return docs.select(*keys, "part_no", F.explode_outer(chosen).alias("_s")).filter(F.size("_s.lines") > 0).select(
        *keys, F.col("_s.section").alias("section"), "part_no",
        F.concat(join_lines(F.col("_s.lines")), F.lit("\n")).alias("markdown"))


# Files a task may have open at a time, one for each platform it meets; only a task that meets more sorts its rows first.
OPEN_FILES = 16


def write_documents(docs: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists", **render) -> None:
    """Write records as JSON lines, Markdown or Parquet, one folder per platform.

    Markdown comes as JSON lines too, each with source, platform, section and part_no beside the text, so that every
    document can be found and put together again.
    The output committer publishes all files or none; nothing passes through the driver.  JSON lines are compressed
    (gzip): every record names all its fields.
    """
    # The folder column is a copy: the records keep all their fields.
    records = render_markdown(docs, **render) if fmt == "markdown" else docs
    rows = records.withColumn("by_platform", F.col("platform")).write.mode(mode).partitionBy("by_platform")
    with setting(docs.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        if fmt in ("json", "markdown"):
            rows.option("ignoreNullFields", "false").option("compression", "gzip").json(path)
        elif fmt == "parquet":
            rows.parquet(path)
        else:
            raise ValueError(f"unknown format: {fmt!r}")


MANIFEST = "manifest"
_SINGLE = {"json_files": "json", "markdown_files": "markdown"}


def _manifests(spark: SparkSession, path: str):
    """The file system, and (number, path) of the manifests under ``path``, newest first."""
    files, where = file_system(spark, f"{path.rstrip('/')}/{MANIFEST}-*.json")
    found = [(int(f.getPath().getName()[len(MANIFEST) + 1 : -5]), f.getPath()) for f in files.globStatus(where) or []]
    return files, sorted(found, key=lambda m: -m[0])


def published(spark: SparkSession, path: str) -> dict | None:
    """version, format and folder of what is published under ``path``: the newest manifest that is whole."""
    files, found = _manifests(spark, path)
    for _, where in found:
        stream = files.open(where)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            manifest = json.loads(text)
        except ValueError:
            # Its writer was ended; the version before it stands.
            continue
        return {**manifest, "folder": f"{path.rstrip('/')}/{manifest['version']}"}
    return None


def publish_documents(docs: DataFrame, path: str, fmt: str = "json", **render) -> str:
    """G2, all or nothing on any file system: a new version folder, and a manifest that names it, written last.

    Readers (:func:`published`, :func:`read_published`) see the version before until the manifest is there; a write that
    is ended leaves a folder no manifest names.  Nothing is renamed or overwritten: a manifest has the next number, and of
    two writers that take the same one the second fails.  Formats are those of :func:`write_documents`, and
    ``json_files`` and ``markdown_files`` with one text file for each document, in a folder named by a digest of platform
    and source; ``index`` tells which.  Returns the version's folder.
    """
    spark = docs.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    if fmt in _SINGLE:
        _write_files(docs, folder, _SINGLE[fmt], **render)
    else:
        write_documents(docs, folder, fmt, **render)
    files, found = _manifests(spark, path)
    number = found[0][0] + 1 if found else 0
    _, where = file_system(spark, f"{path.rstrip('/')}/{MANIFEST}-{number}.json")
    stream = files.create(where, False)
    try:
        stream.write(bytearray(json.dumps({"version": version, "format": fmt}).encode()))
    finally:
        stream.close()
    return folder


def _write_files(docs: DataFrame, folder: str, fmt: str, **render) -> None:
    key = F.sha2(F.to_json(F.struct("platform", "source"), {"ignoreNullFields": "false"}), 256)
    if fmt == "markdown":
        order = ["section", "part_no"]
        # The line separator puts the last new line back.
        rows = render_markdown(docs, **render).select(key.alias("document"), *order, F.regexp_replace("markdown", r"\n\z", "").alias("value"))
    else:
        order = ["part_no"]
        part = F.col("part_no") if "part_no" in docs.columns else F.lit(0)
        rows = docs.select(key.alias("document"), part.alias("part_no"), F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("value"))
    # A document is written by one task, which has one file open at a time.
    rows.repartition("document").sortWithinPartitions("document", *order).drop(*order).write.partitionBy("document").text(f"{folder}/documents")
    docs.select(key.alias("document"), "platform", "source").distinct().write.parquet(f"{folder}/index")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The published documents: records, or document, platform, source and text of single files."""
    manifest = published(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    folder, fmt = manifest["folder"], manifest["format"]
    if fmt in _SINGLE:
        texts = spark.read.text(f"{folder}/documents", wholetext=True).withColumnRenamed("value", "text")
        return spark.read.parquet(f"{folder}/index").join(texts, "document")
    return (spark.read.parquet(folder) if fmt == "parquet" else spark.read.json(folder)).drop("by_platform")
