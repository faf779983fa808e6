"""Media selection and enrichment joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import ordered
from ..functions.lineage import stored
from ..functions.text import strip, suffix_of, truthy, whole_json


def media_kind(path: Column) -> Column:
    ext = suffix_of(path)
    return F.when(ext.isin(rules.IMAGE_EXTS), "image").when(ext.isin(rules.AV_EXTS), "av").otherwise("other")


def record_keys(docs: DataFrame, doc_key: str | list[str] | None) -> list[str]:
    """Columns that name a record row: the given ones, else source and, where present, part_no."""
    if doc_key is None:
        return ["source", "part_no"] if "part_no" in docs.columns else ["source"]
    return [doc_key] if isinstance(doc_key, str) else list(doc_key)


def explode_media(docs: DataFrame, doc_key: str | list[str] | None = None) -> DataFrame:
    """one row per media path with its ``kind`` and position; documents without media keep one empty row."""
    rows = docs.select(*record_keys(docs, doc_key), F.posexplode_outer("media_paths").alias("position", "media_path"))
    return rows.withColumn("kind", F.when(F.col("media_path").isNotNull(), media_kind(F.col("media_path"))))


def apply_provider(assets: DataFrame, fn: Callable, result: str, secrets: list[str] | None = None, start: Callable | None = None,
                   retries: int = 0, concurrency: int = 1) -> DataFrame:
    """run a caller's function over asset batches.

    ``fn(pandas.DataFrame) -> iterable`` yields one dict per input row, or an exception object for a row that failed.
    What a generator has yielded is kept when it raises: the row it raised at becomes a ``failed`` row and the
    function is called again for the rows behind it, so no row is worked on twice and one bad item never ends the job.
    A function that returns its answers whole is called row by row after it raised.  ``result`` is the DDL of the function's own columns.

    With ``start()``, which is called once in each task, the function is ``fn(rows, client)``; a client with a ``close``
    is closed when the task ends, and one that cannot be started makes its task's rows ``failed``.  ``retries`` is how
    many failed rows a task may try once more, over all its batches; ``concurrency`` how many parts of a batch are
    worked on at the same time, so a client used by more than one has to stand that.
    """
    names = [f.strip().split(" ")[0] for f in result.split(",")]
    hidden = [s for s in secrets or [] if s]
    own = list(assets.columns)

    def message(error: Exception) -> str:
        text = f"{type(error).__name__}: {error}"
        for s in hidden:
            text = text.replace(s, rules.REDACTED)
        return text

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def outcome(answer) -> dict:
            if isinstance(answer, Exception):
                return {**dict.fromkeys(names), "status": "failed", "error": message(answer)}
            return {**{n: answer.get(n) for n in names}, "status": "ok", "error": None}

        def called(rows) -> list[dict]:
            """Answers of some rows, or of those up to the one at which the function raised."""
            answers: list[dict] = []
            given = None
            try:
                given = fn(rows) if start is None else fn(rows, client)
                for answer in given:
                    answers.append(outcome(answer))
                if len(answers) != len(rows):
                    raise ValueError("one answer per row expected")
            except Exception as e:
                if not isinstance(given, Iterator) and len(rows) > 1:
                    # A list comes whole or not at all: row by row tells which one failed.
                    return [a for i in range(len(rows)) for a in called(rows.iloc[[i]])]
                return [*answers[: len(rows) - 1], outcome(e)]
            return answers

        def part(rows) -> list[dict]:
            answers: list[dict] = []
            while len(answers) < len(rows):
                answers += called(rows.iloc[len(answers):])
            return answers

        client, broken, left = None, None, retries
        if start is not None:
            try:
                client = start()
            except Exception as e:
                broken = outcome(e)
        pool = ThreadPoolExecutor(concurrency) if concurrency > 1 else None

        def answered(rows) -> list[dict]:
            if broken is not None:
                return [broken] * len(rows)
            if pool is None or len(rows) < 2:
                return part(rows)
            step = -(-len(rows) // concurrency)
            parts = pool.map(part, [rows.iloc[i : i + step] for i in range(0, len(rows), step)])
            return [a for own in parts for a in own]

        try:
            for batch in batches:
                answers = answered(batch)
                failed = [i for i, a in enumerate(answers) if a["status"] == "failed"]
                while failed and left > 0 and broken is None:
                    again = failed[:left]
                    left -= len(again)
                    for i, answer in zip(again, answered(batch.iloc[again]), strict=True):
                        answers[i] = answer
                    failed = [i for i in again if answers[i]["status"] == "failed"]
                found = pd.DataFrame(answers, columns=[*names, "status", "error"], index=batch.index)
                yield pd.concat([batch[own], found], axis=1)
        finally:
            if pool is not None:
                pool.shutdown()
            if client is not None and hasattr(client, "close"):
                client.close()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in assets.schema)
    return assets.mapInPandas(run, f"{ddl}, {result}, status string, error string")


def classify_errors(calls: DataFrame) -> DataFrame:
    """F8: ``error_class`` per provider call (null for a success)."""
    status, body = F.col("http_status"), F.coalesce(F.col("body"), F.lit(""))
    low = F.lower(body)
    details = F.from_json(
        whole_json(body), "error struct<details:array<struct<`@type`:string,violations:array<struct<quotaId:string,"
              "quotaMetric:string>>>>>")["error"]["details"]
    daily = F.coalesce(F.exists(
        details,
        lambda d: d["@type"].contains("QuotaFailure") & F.exists(
            d["violations"],
            lambda v: F.lower(F.concat(F.coalesce(v["quotaId"], F.lit("")), F.coalesce(v["quotaMetric"], F.lit(""))))
            .contains("perday"))), F.lit(False))
    throttled = (status == 429) | ((status == 403) & body.contains("RESOURCE_EXHAUSTED"))
    gemini = (
        F.when(throttled, F.when(daily, "quota").otherwise("rate_limited"))
        .when(status >= 500, "server").when(status != 200, "other"))
    spent = (status == 402) | ((status == 403) & (low.contains("credit") | low.contains("quota")))
    nim = F.when(spent, "quota").when(status == 429, "rate_limited").when(status != 200, "other")
    parsed = F.from_json(whole_json(body), "text string")["text"]
    groq = (
        F.when(status == 429, "rate_limited").when(status.isin(401, 403), "auth").when(status.isin(400, 413), "rejected")
        .when(status >= 500, "server").when(status != 200, "other").when(parsed.isNull(), "parse"))
    return calls.withColumn(
        "error_class",
        F.when(F.col("provider") == "gemini", gemini).when(F.col("provider").startswith("nim"), nim)
        .when(F.col("provider") == "groq", groq).when(status != 200, "other"))


def _by_rank(rank_of: list[str], name: Column) -> Column:
    rank = None
    for i, n in enumerate(rank_of):
        rank = F.when(name == n, i) if rank is None else rank.when(name == n, i)
    return rank


def choose_ocr(candidates: DataFrame, judges: DataFrame, mode: str = "ensemble",
               paid: DataFrame | None = None) -> DataFrame:
    """one text per ``media_path``.

    ``candidates``: media_path, provider, ok, text, rate_limited, dead.  ``judges``: media_path, provider, model, ok,
    text, dead.  ``paid`` (allowed paid calls): media_path, role (judge | ocr), model, ok, text.  Candidates are never
    voted on: a judge decides, else the best-ranked candidate stands.
    """
    rank = _by_rank(rules.OCR_PRIORITY, F.col("provider"))
    usable = F.col("ok") & rank.isNotNull()
    per = candidates.groupBy("media_path").agg(
        F.count_if(usable).alias("n_ok"),
        F.min(F.when(usable, F.struct(rank.alias("r"), "provider", "text"))).alias("best"),
        F.coalesce(F.bool_or(F.col("rate_limited")), F.lit(False)).alias("limited"),
        F.coalesce(F.bool_or(~F.col("dead")), F.lit(False)).alias("alive"),
    )
    judge_rank = _by_rank(rules.JUDGE_PRIORITY, F.col("provider"))
    judged = judges.filter(F.col("ok") & ~F.coalesce(F.col("dead"), F.lit(False)) & judge_rank.isNotNull()).groupBy(
        "media_path").agg(F.min(F.struct(judge_rank.alias("r"), "model", "text")).alias("judge"))
    joined = per.join(judged, "media_path", "left")
    if paid is None:
        nothing = F.lit(None).cast("struct<model:string,text:string>")
        joined = joined.withColumn("paid_judge", nothing).withColumn("paid_ocr", nothing)
    else:
        bought = paid.filter("ok").groupBy("media_path").agg(
            F.min(F.when(F.col("role") == "judge", F.struct("model", "text"))).alias("paid_judge"),
            F.min(F.when(F.col("role") == "ocr", F.struct("model", "text"))).alias("paid_ocr"))
        joined = joined.join(bought, "media_path", "left")
    many = (F.col("n_ok") >= 2) & F.lit(mode != "solo")
    blocked = F.col("limited") & F.col("alive")
    pick = lambda how, model, text: F.struct(
        F.lit(how).alias("mode"), model.alias("model"), strip(text).alias("text"))
    named = lambda label, c: F.concat(F.lit(f"{label}("), c, F.lit(")"))
    chosen = (
        F.when(many & F.col("judge").isNotNull(),
               pick("ensemble", named("ensemble", F.concat(F.lit("judge="), "judge.model")), F.col("judge.text")))
        .when(many & F.col("paid_judge").isNotNull(),
              pick("paid_judge", named("paid_judge", F.col("paid_judge.model")), F.col("paid_judge.text")))
        .when(F.col("n_ok") >= 1, pick("solo", named("solo", F.col("best.provider")), F.col("best.text")))
        .when(~blocked & F.col("paid_ocr").isNotNull(),
              pick("paid_solo", named("paid_solo", F.col("paid_ocr.model")), F.col("paid_ocr.text")))
    )
    return joined.withColumn("_c", chosen).select(
        "media_path", F.col("_c.mode").alias("mode"), F.col("_c.model").alias("model"), F.col("_c.text").alias("text"),
        F.when(F.col("_c").isNull(), "failed").otherwise("ok").alias("status"),
        F.when(F.col("_c").isNull(), F.when(blocked, "rate_limited").otherwise("no_provider")).alias("error"))


def _label(total: Column, done: Column, skipped: str, available: bool) -> Column:
    if not available:
        return F.when(total == 0, "none").otherwise(skipped)
    return (
        F.when(total == 0, "none").when(done == total, "done").when(done == 0, "failed").otherwise("partial"))


def _attached(docs: DataFrame, wanted: Column, kind: str, results: DataFrame, fields: list[str]) -> DataFrame:
    """``docs`` with the number of paths of a kind (``_total``) and the results found for them in order (``_hits``).

    What is found depends on the list of paths alone, so each distinct list is looked up once, whatever documents
    share it or a ``source``; the lists and what is found are written to the shared folder.  Documents without such a path
    are not shuffled, and none is where the lists are few enough for Spark to broadcast.
    """
    has = wanted & F.exists("media_paths", lambda p: media_kind(p) == kind)
    marked = docs.withColumn("_list", F.when(F.coalesce(has, F.lit(False)), F.sha2(F.to_json(F.struct("media_paths")), 256)))
    with_paths = marked.filter("_list IS NOT NULL")
    # Stored, so that the documents are read once for them and Spark knows their size.
    lists = stored(with_paths.select("_list", "media_paths").dropDuplicates(["_list"]), "lists")
    paths = lists.select("_list", F.posexplode("media_paths").alias("position", "media_path")).filter(
        media_kind(F.col("media_path")) == kind)
    joined = ordered.lookup(paths, results.select("media_path", F.struct(*fields).alias("_r")), ["media_path"])
    hit = F.when(F.col("_r").isNotNull(), F.struct("position", "media_path", F.col("_r")))
    found = stored(joined.groupBy("_list").agg(
        F.count("*").alias("_total"), F.array_sort(F.collect_list(hit)).alias("_hits")), "found")
    if ordered.fits_broadcast(found):
        return marked.join(found, "_list", "left").drop("_list")
    return ordered.lookup(with_paths, found, ["_list"]).unionByName(
        marked.filter("_list IS NULL"), allowMissingColumns=True).drop("_list")


def _with_meta(meta: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        meta = meta.withField(name, value)
    return meta


def enrich_ocr(docs: DataFrame, ocr: DataFrame | None) -> DataFrame:
    """fill ``ocr_text`` from an (media_path, text, model, status) table, unique per path; ``None`` = no provider.

    The label counts all images of a document; one whose text is missing is not done.  A document's paths come from
    one row, so the regrouped lists are no larger than that row.
    """
    own = list(docs.columns)
    available = ocr is not None
    results = ocr.filter(F.col("status") == "ok") if available else docs.sparkSession.createDataFrame(
        [], "media_path string, text string, model string")
    joined = _attached(docs, F.lit(True), "image", results, ["text", "model"])
    hits = F.coalesce(F.col("_hits"), F.array())
    total, done = F.coalesce(F.col("_total"), F.lit(0)), F.size(hits)
    texts = F.transform(hits, lambda h: F.struct(
        h["media_path"].alias("media_path"), h["_r"]["text"].alias("text"), h["_r"]["model"].alias("model")))
    return (
        joined.withColumn("ocr_text", texts)
        .withColumn("meta", _with_meta(
            F.col("meta"), ocr_label=_label(total, done, "skipped_no_provider", available),
            ocr_provider=F.try_element_at(hits, F.lit(-1))["_r"]["model"]))
        .select(*own)
    )


def choose_transcript(calls: DataFrame) -> DataFrame:
    """one outcome per ``media_path`` from its calls (backend, model, seq, status, retry_after, text).

    A local success wins.  Of the remote models the second is asked only after 429; a short Retry-After allows one
    retry on the same model; any other error ends the backend.
    """
    model = _by_rank(rules.TRANSCRIBE_ORDER, F.col("model"))
    remote = (F.col("backend") == "groq") & model.isNotNull()
    ranked = calls.withColumn("_model", F.when(remote, model))
    # Calls per model are few in an honest log; only the first two of a model can ever count.
    shown = F.struct("seq", "status", "retry_after", "text", F.col("model").alias("name"))
    first = {i: F.min(F.when(F.col("_model") == i, shown)).alias(f"a{i}") for i in (0, 1)}
    local = F.min(F.when((F.col("backend") == "local") & (F.col("status") == 200), shown)).alias("local")
    any_call = ranked.groupBy("media_path").agg(local, *first.values())
    second = ordered.first_by(ranked.filter("_model is not null"), ["media_path", "_model"], ["seq"], 2).groupBy(
        "media_path").agg(*[F.max(F.when(F.col("_model") == i, shown)).alias(f"b{i}") for i in (0, 1)])
    both = any_call.join(second, "media_path", "left")

    def outcome(i: int) -> Column:
        """What model ``i`` ended with: its first call, or the retry a short Retry-After allowed."""
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        retried = (a["status"] == 429) & (a["retry_after"] <= rules.MAX_RETRY_AFTER) & (b["seq"] > a["seq"])
        return F.when(F.coalesce(retried, F.lit(False)), b).otherwise(a)

    out = both.withColumn("_o0", outcome(0)).withColumn("_o1", outcome(1))
    o0, o1, kept = F.col("_o0"), F.col("_o1"), F.col("local")
    first_ok = o0["status"] == 200
    fallback = (o0.isNull() | (o0["status"] == 429)) & (o1["status"] == 200)
    win = (
        F.when(kept.isNotNull(), F.struct(kept["text"].alias("text"), kept["name"].alias("model"), F.lit("local").alias("backend")))
        .when(first_ok, F.struct(strip(o0["text"]).alias("text"), o0["name"].alias("model"), F.lit("groq").alias("backend")))
        .when(fallback, F.struct(strip(o1["text"]).alias("text"), o1["name"].alias("model"), F.lit("groq").alias("backend"))))
    limited = F.coalesce(o0["status"] == 429, F.lit(True)) & F.coalesce(o1["status"] == 429, F.lit(True)) & (
        o0.isNotNull() | o1.isNotNull())
    return out.withColumn("_w", win).select(
        "media_path", "_w.text", "_w.model", "_w.backend",
        F.when(F.col("_w").isNotNull(), "ok").otherwise("failed").alias("status"),
        F.when(F.col("_w").isNull(), F.when(limited, "rate_limited").otherwise("error")).alias("error"))


def enrich_transcribe(docs: DataFrame, transcripts: DataFrame | None) -> DataFrame:
    """fill ``transcript`` from (media_path, text, model, backend, status); ``None`` = no backend.

    A document that already has a transcript passes unchanged, label included.
    """
    own = list(docs.columns)
    available = transcripts is not None
    results = transcripts.filter(F.col("status") == "ok") if available else docs.sparkSession.createDataFrame(
        [], "media_path string, text string, model string, backend string")
    joined = _attached(docs, truthy("transcript").isNull(), "av", results, ["text", "model", "backend"])
    given = truthy("transcript").isNotNull()
    hits = F.coalesce(F.col("_hits"), F.array())
    total, done = F.coalesce(F.col("_total"), F.lit(0)), F.size(hits)
    last = F.try_element_at(hits, F.lit(-1))["_r"]
    text = F.array_join(F.transform(hits, lambda h: h["_r"]["text"]), "\n\n")
    filled = _with_meta(
        F.col("meta"), transcript_label=_label(total, done, "skipped_no_tool", available),
        transcript_model=last["model"], transcript_backend=last["backend"],
        transcript_sources=F.transform(hits, lambda h: h["media_path"]))
    return (
        joined.withColumn("_text", F.when(given, F.col("transcript")).when(done > 0, text))
        .withColumn("meta", F.when(given, F.col("meta")).otherwise(filled))
        .withColumn("transcript", F.col("_text"))
        .select(*own)
    )


def precheck_upload(assets: DataFrame, has_ffmpeg: bool) -> DataFrame:
    """``action`` (upload, extract, skip) and ``skip_reason`` from path, size_bytes and extracted_bytes (nullable)."""
    ext, size = suffix_of(F.col("path")), F.col("size_bytes")
    direct = ext.isin(rules.UPLOAD_EXTS) & ~ext.isin(rules.VIDEO_CONTAINERS) & (size <= rules.MAX_UPLOAD_BYTES)
    extracted = F.col("extracted_bytes")
    reason = (
        F.when(direct, None)
        .when(F.lit(not has_ffmpeg), "no_ffmpeg")
        .when(extracted.isNull(), "extract_failed")
        .when(extracted > rules.MAX_UPLOAD_BYTES, "too_large")
    )
    return assets.withColumn("skip_reason", reason).withColumn(
        "action", F.when(direct, "upload").when(F.col("skip_reason").isNull(), "extract").otherwise("skip"))


def auto_transcribe_flag(docs: DataFrame, requested: bool = False) -> DataFrame:
    """local files are always transcribed, others only on request."""
    return docs.withColumn("transcribe", F.lit(requested) | (F.col("platform") == "local"))
