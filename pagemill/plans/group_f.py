"""Queries over media selection, enrichment and output, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions.lineage import new_folder, stored
from ..operators import enrich, output, threads
from . import group_c, group_e
from .group_d import THREADS_SQL, thread_inputs
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


QUERIES["f8_classify_errors"] = group_c.QUERIES.pop("f8_classify_errors")
ORACLES["f8_classify_errors"] = group_c.ORACLES.pop("f8_classify_errors")


def media_records(spark, sf):
    d = table(spark, sf, "media_docs").withColumn(
        "media_paths", F.when(F.col("paths") == "", schema.no_paths()).otherwise(F.split("paths", ",")))
    return d.select(
        "source", "platform", "body_text", schema.no_comments().alias("comments"), schema.no_ocr().alias("ocr_text"),
        "transcript", "media_paths", schema.meta(transcript_label=F.when(F.col("transcript").isNotNull(), "fetched"))
        .alias("meta"))


_PATHS = ctes("media_docs") + """,
x AS (SELECT source, platform, transcript, CASE WHEN paths = '' THEN [] ELSE string_split(paths, ',') END AS ps FROM media_docs),
m AS (SELECT source, generate_subscripts(ps, 1) - 1 AS position, unnest(ps) AS media_path FROM x),
k AS (SELECT *, CASE WHEN regexp_matches(lower(media_path), '\\.(jpg|jpeg|png|webp|gif|bmp)$') THEN 'image'
  WHEN regexp_matches(lower(media_path), '\\.(mp4|mov|mkv|webm|m4a|mp3|wav|aac|ogg)$') THEN 'av' ELSE 'other' END AS kind FROM m)
"""


@query("f1_explode_media", _PATHS + """
SELECT x.source, CAST(position AS INT) AS position, media_path, kind FROM x LEFT JOIN k USING (source)""")
def f1(spark, sf):
    return enrich.explode_media(media_records(spark, sf))


@query("f2_apply_provider", """
SELECT doc_id, text, CASE WHEN doc_id % 10 <> 7 THEN length(text) END AS chars,
  CASE WHEN doc_id % 10 = 7 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 10 = 7 THEN 'ValueError: key ***REDACTED*** refused' END AS error FROM documents""")
def f2(spark, sf):
    def provider(batch):
        for i, text in zip(batch["doc_id"], batch["text"]):
            yield ValueError("key s3cret refused") if i % 10 == 7 else {"chars": len(text)}

    return enrich.apply_provider(
        table(spark, sf, "documents").select("doc_id", "text"), provider, "chars bigint", ["s3cret"])


def _ocr_tables(spark, sf):
    calls = table(spark, sf, "ocr_calls")
    judges = calls.select("media_path", F.expr("CASE WHEN turn = 0 THEN 'gemini' ELSE 'nim_gemma4' END").alias("provider"),
                          "model", F.col("judge_ok").alias("ok"), "text", F.lit(False).alias("dead"))
    paid = calls.select("media_path", "role", "model", F.col("paid_ok").alias("ok"), "text")
    return calls.select("media_path", "provider", "ok", "text", "rate_limited", "dead"), judges, paid


def _chosen(many: str) -> str:
    return ctes("ocr_calls") + f""",
rk AS (SELECT *, CASE provider WHEN 'gemini' THEN 0 WHEN 'nim_gemma4' THEN 1 ELSE 2 END AS r FROM ocr_calls),
p AS (SELECT media_path, count(*) FILTER (ok) AS n_ok, bool_or(rate_limited) AS limited, bool_or(NOT dead) AS alive
  FROM rk GROUP BY media_path),
b AS (SELECT media_path, provider, text FROM rk WHERE ok QUALIFY row_number() OVER (PARTITION BY media_path ORDER BY r, text) = 1),
j AS (SELECT media_path, model, text FROM ocr_calls WHERE judge_ok
  QUALIFY row_number() OVER (PARTITION BY media_path ORDER BY CASE WHEN turn = 0 THEN 1 ELSE 0 END, model, text) = 1),
pj AS (SELECT media_path, model, text FROM ocr_calls WHERE paid_ok AND role = 'judge'
  QUALIFY row_number() OVER (PARTITION BY media_path ORDER BY model, text) = 1),
po AS (SELECT media_path, model, text FROM ocr_calls WHERE paid_ok AND role = 'ocr'
  QUALIFY row_number() OVER (PARTITION BY media_path ORDER BY model, text) = 1),
f AS (SELECT p.media_path, {many} AND n_ok >= 2 AS many, n_ok, limited AND alive AS blocked, b.provider, b.text AS bt,
  j.model AS jm, j.text AS jt, pj.model AS pm, pj.text AS pt, po.model AS om, po.text AS ot
  FROM p LEFT JOIN b USING (media_path) LEFT JOIN j USING (media_path) LEFT JOIN pj USING (media_path) LEFT JOIN po USING (media_path)),
m AS (SELECT *, CASE WHEN many AND jm IS NOT NULL THEN 'ensemble' WHEN many AND pm IS NOT NULL THEN 'paid_judge'
  WHEN n_ok >= 1 THEN 'solo' WHEN NOT blocked AND om IS NOT NULL THEN 'paid_solo' END AS mode FROM f)
SELECT media_path, mode, CASE mode WHEN 'ensemble' THEN concat('ensemble(judge=', jm, ')') WHEN 'paid_judge'
  THEN concat('paid_judge(', pm, ')') WHEN 'solo' THEN concat('solo(', provider, ')') WHEN 'paid_solo'
  THEN concat('paid_solo(', om, ')') END AS model,
  {strip("CASE mode WHEN 'ensemble' THEN jt WHEN 'paid_judge' THEN pt WHEN 'solo' THEN bt WHEN 'paid_solo' THEN ot END")} AS text,
  CASE WHEN mode IS NULL THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN mode IS NULL THEN CASE WHEN blocked THEN 'rate_limited' ELSE 'no_provider' END END AS error
FROM m"""


@query("f3_choose_ocr", _chosen("true"))
def f3(spark, sf):
    candidates, judges, paid = _ocr_tables(spark, sf)
    return enrich.choose_ocr(candidates, judges, "ensemble", paid)


@query("f3_choose_ocr_solo", _chosen("false"))
def f3_solo(spark, sf):
    candidates, judges, paid = _ocr_tables(spark, sf)
    return enrich.choose_ocr(candidates, judges, "solo", paid)


# Results exist for most paths; a path whose hash is unlucky failed or is missing.
def _results(spark, sf):
    paths = enrich.explode_media(media_records(spark, sf)).filter("media_path IS NOT NULL").select("media_path").distinct()
    return paths.select(
        "media_path", F.concat(F.lit("text of "), "media_path").alias("text"),
        F.concat(F.lit("m"), F.length("media_path") % 3).alias("model"), F.lit("groq").alias("backend"),
        F.when(F.length("media_path") % 4 == 3, "failed").otherwise("ok").alias("status"))


_ENRICHED = _PATHS + """,
r AS (SELECT source, position, media_path, kind, length(media_path) % 4 <> 3 AS good,
  'text of ' || media_path AS text, concat('m', length(media_path) % 3) AS model FROM k),
"""


@query("f4_enrich_ocr", _ENRICHED + """
g AS (SELECT source, count(*) AS n, count(*) FILTER (good) AS done,
  string_agg(concat_ws('|', media_path, text, model), chr(10) ORDER BY position) FILTER (good) AS ocr,
  arg_max(model, position) FILTER (good) AS provider FROM r WHERE kind = 'image' GROUP BY source)
SELECT x.source, coalesce(ocr, '') AS ocr_text, CASE WHEN n IS NULL THEN 'none' WHEN done = n THEN 'done'
  WHEN done = 0 THEN 'failed' ELSE 'partial' END AS ocr_label, provider AS ocr_provider FROM x LEFT JOIN g USING (source)""")
def f4(spark, sf):
    done = enrich.enrich_ocr(media_records(spark, sf), _results(spark, sf))
    return done.select("source", F.array_join(F.transform("ocr_text", lambda o: F.concat_ws(
        "|", o["media_path"], o["text"], o["model"])), "\n").alias("ocr_text"), "meta.ocr_label", "meta.ocr_provider")


@query("f4_enrich_ocr_no_provider", _PATHS + """
SELECT x.source, CASE WHEN count(k.source) FILTER (kind = 'image') > 0 THEN 'skipped_no_provider' ELSE 'none' END AS ocr_label
FROM x LEFT JOIN k USING (source) GROUP BY x.source""")
def f4_none(spark, sf):
    return enrich.enrich_ocr(media_records(spark, sf), None).select("source", "meta.ocr_label")


@query("f5_choose_transcript", ctes("speech_calls") + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY media_path, backend, model ORDER BY seq) AS n FROM speech_calls),
a AS (SELECT DISTINCT media_path FROM t),
l AS (SELECT media_path, text, model FROM t WHERE backend = 'local' AND status = 200
  QUALIFY row_number() OVER (PARTITION BY media_path ORDER BY seq) = 1),
o AS (SELECT x.media_path, x.model, CASE WHEN x.status = 429 AND x.retry_after <= 60 AND y.status IS NOT NULL THEN y.status
    ELSE x.status END AS status, CASE WHEN x.status = 429 AND x.retry_after <= 60 AND y.status IS NOT NULL THEN y.text
    ELSE x.text END AS text
  FROM t x LEFT JOIN t y ON y.media_path = x.media_path AND y.backend = x.backend AND y.model = x.model AND y.n = 2
  WHERE x.n = 1 AND x.backend = 'groq'),
w AS (SELECT a.media_path, l.text AS lt, l.model AS lm, o0.status AS s0, o0.text AS t0, o1.status AS s1, o1.text AS t1
  FROM a LEFT JOIN l USING (media_path) LEFT JOIN o o0 ON o0.media_path = a.media_path AND o0.model = 'whisper-large-v3-turbo'
  LEFT JOIN o o1 ON o1.media_path = a.media_path AND o1.model = 'whisper-large-v3'),
m AS (SELECT *, CASE WHEN lm IS NOT NULL THEN 'local' WHEN s0 = 200 THEN 'turbo'
  WHEN (s0 IS NULL OR s0 = 429) AND s1 = 200 THEN 'v3' END AS pick FROM w)
SELECT media_path, CASE pick WHEN 'local' THEN lt WHEN 'turbo' THEN {strip("t0")} WHEN 'v3' THEN {strip("t1")} END AS text,
  CASE pick WHEN 'local' THEN lm WHEN 'turbo' THEN 'whisper-large-v3-turbo' WHEN 'v3' THEN 'whisper-large-v3' END AS model,
  CASE pick WHEN 'local' THEN 'local' WHEN 'turbo' THEN 'groq' WHEN 'v3' THEN 'groq' END AS backend,
  CASE WHEN pick IS NULL THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN pick IS NULL THEN CASE WHEN coalesce(s0 = 429, true) AND coalesce(s1 = 429, true)
    AND (s0 IS NOT NULL OR s1 IS NOT NULL) THEN 'rate_limited' ELSE 'error' END END AS error FROM m""")
def f5(spark, sf):
    return enrich.choose_transcript(table(spark, sf, "speech_calls"))


@query("f6_enrich_transcribe", _ENRICHED + """
g AS (SELECT source, count(*) AS n, count(*) FILTER (good) AS done,
  string_agg(text, chr(10) || chr(10) ORDER BY position) FILTER (good) AS tx,
  string_agg(media_path, ',' ORDER BY position) FILTER (good) AS srcs,
  arg_max(model, position) FILTER (good) AS model FROM r WHERE kind = 'av' GROUP BY source)
SELECT x.source, coalesce(transcript, tx) AS transcript, CASE WHEN transcript IS NOT NULL THEN 'fetched'
    WHEN n IS NULL THEN 'none' WHEN done = n THEN 'done' WHEN done = 0 THEN 'failed' ELSE 'partial' END AS transcript_label,
  CASE WHEN transcript IS NULL THEN model END AS transcript_model,
  CASE WHEN transcript IS NULL AND done > 0 THEN 'groq' END AS transcript_backend,
  CASE WHEN transcript IS NULL THEN coalesce(srcs, '') END AS sources FROM x LEFT JOIN g USING (source)""")
def f6(spark, sf):
    done = enrich.enrich_transcribe(media_records(spark, sf), _results(spark, sf))
    return done.select("source", "transcript", "meta.transcript_label", "meta.transcript_model",
                       "meta.transcript_backend", F.array_join("meta.transcript_sources", ",").alias("sources"))


@query("f7_precheck_upload", ctes("uploads") + """,
e AS (SELECT *, regexp_extract(lower(path), '(\\.[a-z0-9]+)$', 1) AS ext FROM uploads),
d AS (SELECT *, ext IN ('.mp3','.flac') AND size_bytes <= 26214400 AS direct FROM e)
SELECT id, CASE WHEN direct THEN 'upload' WHEN extracted_bytes <= 26214400 THEN 'extract' ELSE 'skip' END AS action,
  CASE WHEN direct THEN NULL WHEN extracted_bytes IS NULL THEN 'extract_failed' WHEN extracted_bytes > 26214400 THEN 'too_large' END
    AS skip_reason FROM d""")
def f7(spark, sf):
    return enrich.precheck_upload(table(spark, sf, "uploads"), True).select("id", "action", "skip_reason")


@query("f9_auto_transcribe_flag", ctes("media_docs") + """
SELECT source, platform, platform = 'local' AS transcribe FROM media_docs""")
def f9(spark, sf):
    return enrich.auto_transcribe_flag(media_records(spark, sf)).select("source", "platform", "transcribe")


# Two thirds of the threads are rendered with a date, media and a transcript.
_RENDER = ctes("thread_posts") + THREADS_SQL + """,
c AS (SELECT thread_id, string_agg(concat('- **', author, '**', CASE WHEN likes IS NOT NULL THEN concat(' ♥', likes) ELSE '' END,
    ': ', replace(coalesce(text, ''), chr(10), ' '), chr(10)), '' ORDER BY seq) FILTER (code <> root_code) AS bullets,
  string_agg(concat('- ', saved, chr(10)), '' ORDER BY seq) FILTER (saved IS NOT NULL) AS media FROM thread_posts GROUP BY thread_id)
SELECT source, 'threads' AS platform, concat('# @', author, ' — threads 포스트 (', root_code, ')', chr(10),
  CASE WHEN body <> '' THEN concat(chr(10), body, chr(10)) ELSE '' END,
  CASE WHEN bullets IS NOT NULL THEN concat(chr(10), '## 댓글 (', captured, '개 수집 / 전체 ~', coalesce(replies, 0), ')', chr(10), chr(10),
    bullets) ELSE '' END,
  CASE WHEN media IS NOT NULL THEN concat(chr(10), '## 미디어', chr(10), chr(10), media) ELSE '' END,
  CASE WHEN thread_id % 2 = 0 THEN concat(chr(10), '## 전사', chr(10), chr(10), 'spoken ', thread_id, chr(10)) ELSE '' END,
  chr(10), '---', chr(10), '플랫폼: threads', CASE WHEN likes IS NOT NULL THEN concat(' · 좋아요: ', likes) ELSE '' END,
  ' · 수집: 2024-05-06T07:08:09+00:00 · 완전성: ',
  CASE WHEN captured < coalesce(replies, 0) THEN concat('부분수집(', captured, '/', replies, ')') ELSE '완전수집' END,
  CASE WHEN NOT (got = images + videos AND images + videos > 0) THEN ' · 미디어 일부 누락' ELSE '' END, chr(10)) AS markdown
FROM t JOIN c USING (thread_id) WHERE found"""


def _rendered_threads(spark, sf):
    records = threads.assemble_threads(
        thread_inputs(spark, sf), downloaded=True, fetched_at=F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return records.filter("reject_reason IS NULL").withColumn(
        "transcript", F.when(F.col("thread_id") % 2 == 0, F.concat(F.lit("spoken "), "thread_id")))


@query("g1_render_markdown", _RENDER)
def g1(spark, sf):
    return output.render_markdown(_rendered_threads(spark, sf)).drop("section", "part_no")


@query("g1_render_documents", _ENRICHED + """
g AS (SELECT source, string_agg(concat('> ', regexp_extract(media_path, '[^/]*$'), ': ', text, chr(10)), '' ORDER BY position)
    FILTER (good AND kind = 'image') AS ocr,
  string_agg(concat('- ..', media_path, chr(10)), '' ORDER BY position) AS media FROM r GROUP BY source)
SELECT d.source, d.platform, concat('# ', d.platform, ' 포스트 (', d.source, ')', chr(10),
  CASE WHEN body_text <> '' THEN concat(chr(10), body_text, chr(10)) ELSE '' END,
  CASE WHEN media IS NOT NULL THEN concat(chr(10), '## 미디어', chr(10), chr(10), media) ELSE '' END,
  CASE WHEN ocr IS NOT NULL THEN concat(chr(10), '## 이미지 속 텍스트 (OCR)', chr(10), chr(10), ocr) ELSE '' END,
  CASE WHEN d.transcript IS NOT NULL THEN concat(chr(10), '## 전사', chr(10), chr(10), d.transcript, chr(10)) ELSE '' END,
  chr(10), '---', chr(10), '플랫폼: ', d.platform, ' · 완전성: 완전수집', chr(10)) AS markdown
FROM media_docs d LEFT JOIN g USING (source)""")
def g1_documents(spark, sf):
    done = enrich.enrich_ocr(media_records(spark, sf), _results(spark, sf))
    return output.render_markdown(done, "relative", "/out").select("source", "platform", "markdown")


@query("g2_write_documents", "SELECT platform, records FROM (" + group_e.ORACLES["e27_union_documents"] + ")")
def g2(spark, sf):
    """Writes all records as JSON lines and reads them back."""
    path = new_folder(spark, "documents")
    docs = group_e.documents(spark, sf)
    output.write_documents(docs, path, "json")
    return spark.read.schema(docs.schema).json(path).groupBy("platform").agg(F.count("*").alias("records"))


@query("g2_publish_documents", "SELECT platform, records FROM (" + group_e.ORACLES["e27_union_documents"] + ")")
def g2_publish(spark, sf):
    """Publishes two versions, JSON lines and then Parquet, and reads the newer."""
    path = new_folder(spark, "published")
    docs = group_e.documents(spark, sf)
    output.publish_documents(docs, path, "json")
    output.publish_documents(docs, path, "parquet")
    return output.read_published(spark, path).groupBy("platform").agg(F.count("*").alias("records"))


# What every record of the union shows, from the driver tables: its key, title and last line.
_LINES = group_e.ctes("infos", "dumps", "photo_posts", "blog_posts", "base_posts", "thread_posts", "media_files") + THREADS_SQL + """,
r AS (
  SELECT 'web' AS platform, url AS source, NULL AS author, url AS code, NULL AS likes, '완전수집' AS complete FROM pages
  UNION ALL SELECT 'threads', source, author, root_code, likes,
    concat(CASE WHEN found AND captured < coalesce(replies, 0) THEN concat('부분수집(', captured, '/', replies, ')') ELSE '완전수집' END,
      CASE WHEN NOT (got = images + videos AND images + videos > 0) THEN ' · 미디어 일부 누락' ELSE '' END) FROM t
  UNION ALL SELECT 'youtube', source, NULL, source, NULL, '완전수집' FROM infos
  UNION ALL SELECT 'tiktok', source, CASE WHEN dump LIKE '[[2%' THEN 'nick'
    WHEN dump LIKE '[[1],%' THEN json_extract_string(dump, '$[1][1].author.uniqueId') END, source, NULL, '완전수집' FROM dumps
  UNION ALL SELECT 'instagram', source, owner, source, likes, '완전수집' FROM photo_posts
  UNION ALL SELECT 'local', path, NULL, path, NULL, '완전수집' FROM media_files
  UNION ALL SELECT 'naver_blog', concat('https://blog.naver.com/', blog_id, '/', log_no), NULL,
    concat('https://blog.naver.com/', blog_id, '/', log_no), NULL, '완전수집' FROM blog_posts
  UNION ALL SELECT 'facebook', permalink, NULL, permalink, likes, '완전수집' FROM base_posts),
lines AS (SELECT platform, source, concat('# ', CASE WHEN author IS NOT NULL THEN concat('@', author, ' — ') ELSE '' END,
    platform, ' 포스트 (', code, ')') AS title,
  concat('플랫폼: ', platform, CASE WHEN likes IS NOT NULL THEN concat(' · 좋아요: ', likes) ELSE '' END, ' · 완전성: ', complete) AS footer
  FROM r)
"""


def _shown(rendered):
    return rendered.withColumns({
        "title": F.substring_index("markdown", "\n", 1),
        "footer": F.substring_index(F.regexp_replace("markdown", "\n$", ""), "\n", -1)})


@query("pipeline_render_all", _LINES + "SELECT *, true AS body_shown FROM lines")
def render_all(spark, sf):
    """Every record of the union rendered: none is lost, each has its title, body and last line."""
    rendered = output.render_markdown(group_e.documents(spark, sf), keys=["source", "platform", "body_text"])
    return _shown(rendered).select(
        "platform", "source", "title", "footer", F.coalesce(F.col("markdown").contains(F.col("body_text")), F.lit(True)).alias("body_shown"))


@query("pipeline_enrich_all", _LINES + """
SELECT platform, source, CASE WHEN length(source) % 7 = 3 THEN 'failed' ELSE 'done' END AS ocr_label,
  CASE WHEN length(source) % 7 = 3 THEN '' ELSE concat('text of /m/', length(source) % 7, '.jpg') END AS ocr_text,
  CASE WHEN length(source) % 5 = 2 THEN 'failed' ELSE 'done' END AS transcript_label,
  CASE WHEN length(source) % 5 <> 2 THEN concat('text of /m/', length(source) % 5, '.mp4') END AS transcript FROM lines""")
def enrich_all(spark, sf):
    """Every record of the union, given an image and a video, with its texts and honest labels."""
    path = lambda n, ext: F.concat(F.lit("/m/"), (F.length("source") % n).cast("string"), F.lit(ext))
    # Written once: the enrichments read it several times.
    docs = stored(group_e.documents(spark, sf).withColumn("media_paths", F.array(path(7, ".jpg"), path(5, ".mp4"))), "documents")
    paths = stored(docs.select(F.explode("media_paths").alias("media_path")).distinct(), "paths")
    results = paths.select(
        "media_path", F.concat(F.lit("text of "), "media_path").alias("text"), F.lit("m").alias("model"), F.lit("groq").alias("backend"),
        F.when(F.col("media_path").isin("/m/3.jpg", "/m/2.mp4"), "failed").otherwise("ok").alias("status"))
    done = enrich.enrich_transcribe(enrich.enrich_ocr(docs, results), results)
    return done.select("platform", "source", "meta.ocr_label", F.array_join(F.transform(
        "ocr_text", lambda o: o["text"]), ",").alias("ocr_text"), "meta.transcript_label", "transcript")


@query("g2_write_markdown", _LINES + "SELECT *, 1 AS section, 0 AS part_no FROM lines")
def g2_markdown(spark, sf):
    """Writes all records as Markdown and reads every document back by its key."""
    path = new_folder(spark, "markdown")
    output.write_documents(group_e.documents(spark, sf), path, "markdown")
    back = spark.read.schema("source string, platform string, section int, part_no int, markdown string").json(path)
    return _shown(back).select("platform", "source", "title", "footer", "section", "part_no")


@query("g3_completeness_label", ctes("thread_posts") + THREADS_SQL + """
SELECT thread_id, concat(CASE WHEN found AND captured < coalesce(replies, 0) THEN concat('부분수집(', captured, '/', replies, ')')
  ELSE '완전수집' END, CASE WHEN NOT (got = images + videos AND images + videos > 0) THEN ' · 미디어 일부 누락' ELSE '' END)
  AS completeness_label FROM t""")
def g3(spark, sf):
    return output.completeness_label(threads.assemble_threads(thread_inputs(spark, sf))).select(
        "thread_id", "completeness_label")
