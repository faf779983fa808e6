import json
import random

import pytest
from pyspark.sql import functions as F

from pagemill import schema
from pagemill.operators import blog, enrich, output, timeline, video
from pagemill.sources import captures


def test_rates_round_like_python(spark):
    rng = random.Random(3)
    cases = [(1, 2_000_000), (3, 2_000_000), (5, 2_000_000), (1, 64), (7, 128), (1, 3), (999, 1000), (13, 16_000_000)]
    cases += [(rng.randrange(1, 5000), rng.choice([2_000_000, 4_000_000, 640_000, rng.randrange(1, 10**7)]))
              for _ in range(3000)]
    df = spark.createDataFrame([(a, b, 0) for a, b in cases], "like_count long, view_count long, comment_count long")
    for r in video.engagement(df).collect():
        assert r.like_rate == round(r.like_count / r.view_count, 6), (r.like_count, r.view_count)


def test_engagement_labels(spark):
    df = spark.createDataFrame([("0", "1", "1"), (None, "1", "1"), ("x", "1", "1"), ("-1", "1", "1"), ("1000", "10", None)],
                               "view_count string, like_count string, comment_count string")
    got = [(r.like_rate, r.comment_rate, r.engagement_label) for r in video.engagement(df).collect()]
    assert got == [(None, None, "zero_views"), (None, None, "unavailable"), (None, None, "unavailable"),
                   (None, None, "unavailable"), (0.01, 0.0, "computed")]


def test_transcripts(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", " ", "a", "b  c", "b c", "\n", None, "d\ne", "a"])] + [(2, 0, " \t")]
    rows += [(3, i, f"line {i // 2}") for i in range(100)]
    df = spark.createDataFrame(rows, "video_id long, seq long, text string")
    got = {r.video_id: r for r in video.clean_transcript(df).collect()}
    assert got[1].transcript == "a\nb c\nd e\na" and (got[2].transcript, got[2].transcript_label) == (None, "unavailable")
    parts = [r.transcript for r in video.clean_transcript(df, 7).filter("video_id = 3").orderBy("part_no").collect()]
    assert len(parts) > 5 and "\n".join(parts) == got[3].transcript == "\n".join(f"line {i}" for i in range(50))


def test_top_comments(spark):
    rows = [(1, i, f"a{i}", "t", "3", "1d", False, False, i == 2) for i in range(6)]
    df = spark.createDataFrame(rows, "video_id long, seq long, author string, text string, votes string, time string, "
                                     "heart boolean, reply boolean, is_error boolean")
    for limit, n, label in [(1, 1, "fetched"), (2, 2, "fetch_failed"), (20, 2, "fetch_failed"), (0, 0, "fetched")]:
        r = video.top_comments(df, limit).first()
        assert (len(r.comments), r.comments_label) == (n, label)


def test_dumps(spark):
    rows = [json.dumps(d) for d in (
        [[2, {"id": "x"}], [3, {"id": "y", "desc": "d", "createTime": 1700000000.0, "stats": {"diggCount": None}}]],
        [[1, "t"], [2, {"id": "z", "author": {"uniqueId": "u", "nickname": "n"}}]], [[1, "t"]], {"a": 1})]
    df = spark.createDataFrame([(r, r) for r in rows], "source string, dump string")
    got = [(r.meta.extra.get("video_id"), r.body_text, r.meta.author, r.meta.extra.get("created_at_utc"), r.reject_reason)
           for r in video.normalize_tiktok(df).collect()]
    assert got == [("y", "d", None, "2023-11-14T22:13:20Z", None), ("z", "", "u", None, None),
                   (None, "", None, None, "no payload object"), (None, "", None, None, "no payload object")]


def test_photo_comments_in_parts(spark):
    posts = spark.createDataFrame(
        [("u1", "A", None, None), ("u2", "B", None, None), ("u3", "C", "connection", None), ("u4", "D", None, "x")],
        "source string, shortcode string, access_error string, comments_error string").withColumns({
            "comments_error": F.coalesce("comments_error", F.when(F.col("shortcode") != "B", "ok")),
            "caption": F.lit("cap"), **{c: F.lit(None).cast(t) for c, t in [
                ("owner", "string"), ("post_id", "long"), ("likes", "long"),
                ("comment_count", "long"), ("is_video", "boolean"), ("date_utc", "timestamp")]}})
    comments = spark.createDataFrame(
        [(c, i, str(i), "a", "t", 1, None) for c in "ABCD" for i in range(25)],
        "shortcode string, seq long, id string, author string, text string, likes long, created_at timestamp")
    got = timeline.normalize_instagram(posts, comments, part_rows=10).orderBy("source", "part_no").collect()
    assert [(r.source, r.part_no, len(r.comments)) for r in got] == [
        ("u1", 0, 10), ("u1", 1, 10), ("u1", 2, 5), ("u2", 0, 0), ("u3", 0, 0), ("u4", 0, 0)]
    assert [(r.part_count, r.body_text) for r in got[:3]] == [(3, "cap"), (3, ""), (3, "")] and {r.part_count for r in got[3:]} == {1}
    text = "".join(r.markdown for r in output.render_markdown(timeline.union_documents(
        timeline.normalize_instagram(posts, comments, part_rows=10))).filter("source = 'u1'").orderBy("section", "part_no").collect())
    assert text.count("# instagram 포스트 (u1)") == 1 and text.count("(25개 수집)") == 1 and text.count("- **a**: t") == 25
    assert text.count("플랫폼: instagram") == 1
    assert [r.meta.extra["comments_label"] for r in got[2:]] == ["collected", "not_requested", "collected", "fetch_failed"]
    assert got[4].reject_reason == "anonymous_blocked" and got[0].meta.comment_count_captured == 25


def page(n):
    return json.dumps({"result": {"items": [{"i": i} for i in range(n)]}})


@pytest.mark.parametrize("sizes, want", [
    ([30, 30, 12, 30], 72), ([30, None, 30], 30), ([0, 30], 0), ([30, "x", 30], 30), ([30, "[]"], 30), ([12], 12)])
def test_listing_pages(spark, sizes, want):
    rows = [("b", i + 1, 500 if s is None else 200, page(s) if isinstance(s, int) else s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "blog_id string, page long, status int, body string")
    got = blog.concat_list_pages(df).orderBy("position").collect()
    assert [r.position for r in got] == list(range(want))
    assert blog.concat_list_pages(df, max_posts=5).count() == min(5, want)


def test_image_variants(spark):
    urls = spark.createDataFrame([
        (1, "https://blogfiles.pstatic.net/a.jpg?type=w80"), (2, "https://postfiles.pstatic.net/b.jpg"),
        (3, "https://x.pstatic.net/c.jpg"), (4, "https://blogfiles.pstatic.net/d.jpg")], "image_id long, url string")
    answers = spark.createDataFrame([
        ("https://blogfiles.pstatic.net/a.jpg", 200, 900), ("https://blogfiles.pstatic.net/a.jpg?type=w3840", 200, 9000),
        ("https://postfiles.pstatic.net/b.jpg?type=w966", 403, 0), ("https://blogfiles.pstatic.net/d.jpg", 404, 0)],
        "url string, status int, bytes long")
    got = {r.image_id: r.label for r in blog.pick_image_variant(urls, answers).collect()}
    assert got == {1: "original_w3840", 2: "failed:error", 3: "failed:notfound", 4: "failed:notfound"}
    labels = spark.createDataFrame([(1, 0, "w966_ceiling"), (1, 1, "original_w3840"), (1, 2, "original"), (2, 0, None)],
                                   "post_id long, position long, label string")
    assert {r.post_id: r.image_size_label for r in blog.best_size_label(labels).collect()} == {
        1: "original_w3840", 2: "none"}


def test_comment_lines(spark):
    cases = {
        "A\n메시지\n15시간\n좋아요\n답글 달기\n9": ("A", "메시지", 9), "A\n50000": ("A", "50000", None),
        "A\nx\n7\nLike\n1,234": ("A", "x\n7", 1234), "": (None, "", None), "A\n2h\nReply": ("A", "", None),
        "A\nmsg\n원본 보기(영어)\nYesterday": ("A", "msg", None), "A\n9\n8": ("A", "9\n8", None),
        "A\nLike\nhello": ("A", "Like\nhello", None), "A\nx\n３시간": ("A", "x", None)}
    df = spark.createDataFrame([(c,) for c in cases], "raw_text string")
    for r in timeline.parse_comments(df).collect():
        assert (r.author, r.text, r.likes) == cases[r.raw_text], r.raw_text
        assert r.parse_failed == (r.text == "")


def test_comment_labels(spark):
    names = "raw_count comment_count parse_fail expand_hit_cap expand_interrupted body_matched caption_given".split()
    base = dict(zip(names, (3, 3, 0, False, False, True, True)))
    cases = [({}, "collected"), ({"raw_count": 0, "comment_count": 0}, "none"),
             ({"raw_count": 5, "comment_count": 0, "parse_fail": 5}, "fetch_failed"), ({"parse_fail": 1}, "partial"),
             ({"expand_hit_cap": True}, "partial"), ({"expand_interrupted": True}, "partial"),
             ({"body_matched": False}, "partial"), ({"body_matched": False, "caption_given": False}, "collected")]
    rows = [tuple({**base, **c}[n] for n in names) for c, _ in cases]
    df = spark.createDataFrame(rows, ", ".join(
        f"{n} {'long' if i < 3 else 'boolean'}" for i, n in enumerate(names)))
    assert [r.comments_label for r in timeline.comments_label(df).collect()] == [w for _, w in cases]


def test_timeline(spark):
    rows = [("p", 0, 0, "https://f/1?a", "t", ["i"]), ("p", 1, 0, "https://f/1?b", "t2", []), ("p", 0, 1, None, "x" * 90, []),
            ("p", 1, 1, None, "x" * 90 + "y", []), ("p", 1, 2, None, "x" * 90, ["i"]), ("p", 2, 0, None, "", ["i"])]
    df = spark.createDataFrame(rows, "profile string, scroll int, pos int, permalink string, text string, images array<string>")
    got = timeline.dedup_timeline(df).orderBy("scroll", "pos").collect()
    # Posts that only begin alike are different posts.
    assert [(r.scroll, r.pos) for r in got] == [(0, 0), (0, 1), (1, 1), (1, 2)]


def test_media_of_a_profile(spark):
    rng = random.Random(9)
    posts = [("p", s, [f"i{rng.randrange(12)}?{s}{j}" for j in range(4)], [f"v{rng.randrange(5)}?{s}{j}" for j in range(3)])
             for s in range(40)]
    df = spark.createDataFrame(posts, "profile string, post_seq long, image_urls array<string>, video_urls array<string>")
    seen_i, seen_v, want = set(), set(), {}
    for _, s, images, videos in posts:
        fetch = []
        for u in images:
            if u.split("?")[0] not in seen_i:
                seen_i.add(u.split("?")[0])
                fetch.append(u)
        fresh = [u for u in videos if u.split("?")[0] not in seen_v]
        seen_v.update(u.split("?")[0] for u in fresh)
        want[s] = (fetch, fresh)
    got = {r.post_seq: (r.images_to_fetch, r.video_urls) for r in timeline.dedup_media_across_posts(df).collect()}
    assert got == want


def test_stp_and_upgrades(spark):
    df = spark.createDataFrame([("https://a/b.jpg?stp=x&oh=1",), ("https://a/b.jpg?oh=1&stp=x",), ("https://a/b.jpg?stp=x",)],
                               "u string")
    assert [r.s for r in df.select(timeline.strip_stp(F.col("u")).alias("s")).collect()] == [
        "https://a/b.jpg?oh=1", "https://a/b.jpg?oh=1", "https://a/b.jpg"]
    name = lambda n: f"https://x.fbcdn.net/{n}.png"
    keys = {r.k: r.n for r in spark.createDataFrame([(n,) for n in "abcdefgh"], "n string").select(
        "n", timeline.file_key(F.format_string("https://x.fbcdn.net/%s.png", "n")).alias("k")).collect()}
    have = {"a": (999, 1_080_000), "b": (999, 500), "c": (999, 500), "d": (100, 500)}
    existing = spark.createDataFrame([(k, *have[n]) for k, n in keys.items() if n in have],
                                     "file_key string, bytes long, area long")
    offers = [(name("a"), 200, 999, 9_999_999), (name("b"), 200, 999, 600), (name("c"), 200, 999, 500),
              (name("d"), 200, 999, 10), (name("e"), 200, 100, 10), (name("f"), None, None, None),
              ("https://evil.net/g.png", 200, 999, 10), (name("h"), 404, 0, None)]
    incoming = spark.createDataFrame([(i, *o) for i, o in enumerate(offers)],
                                     "seq long, url string, status int, bytes long, area long")
    got = {keys.get(r.file_key, "g"): r.action for r in timeline.upgrade_media(existing, incoming).collect()}
    assert got == dict(a="cached", b="upgraded", c="kept_existing", d="fetched", e="all_fail", f="req_err",
                       g="skip_host", h="all_fail")


def docs(spark, rows):
    df = spark.createDataFrame(rows, "source string, platform string, media_paths array<string>, transcript string")
    return df.select("source", "platform", F.lit("b").alias("body_text"), schema.no_comments().alias("comments"),
                     schema.no_ocr().alias("ocr_text"), "transcript", "media_paths",
                     schema.meta(transcript_label=F.lit("mine")).alias("meta"))


def test_enrichment(spark):
    rows = [("a", "web", ["g.mp3", "x.JPG", "bad.mp3", "y.png"], None), ("b", "web", [], None), ("c", "web", ["g.mp3"], "given"),
            ("d", "local", ["bad.mp3"], ""), ("e", "web", ["x.jpg", "x.JPG"], None)]
    texts = spark.createDataFrame([("g.mp3", "OK", "m", "groq", "ok"), ("bad.mp3", None, None, None, "failed")],
                                  "media_path string, text string, model string, backend string, status string")
    got = {r.source: r for r in enrich.enrich_transcribe(docs(spark, rows), texts).collect()}
    assert {s: (r.transcript, r.meta.transcript_label) for s, r in got.items()} == {
        "a": ("OK", "partial"), "b": (None, "none"), "c": ("given", "mine"), "d": (None, "failed"), "e": (None, "none")}
    assert got["a"].meta.transcript_sources == ["g.mp3"]
    none = {r.source: r.meta.transcript_label for r in enrich.enrich_transcribe(docs(spark, rows), None).collect()}
    assert none == {"a": "skipped_no_tool", "b": "none", "c": "mine", "d": "skipped_no_tool", "e": "none"}
    ocr = spark.createDataFrame([("x.JPG", "T", "m1", "ok"), ("y.png", "U", "m2", "ok")],
                                "media_path string, text string, model string, status string")
    got = {r.source: r for r in enrich.enrich_ocr(docs(spark, rows), ocr).collect()}
    assert [o.text for o in got["a"].ocr_text] == ["T", "U"]
    assert {s: (r.meta.ocr_label, r.meta.ocr_provider) for s, r in got.items()} == {
        "a": ("done", "m2"), "b": ("none", None), "c": ("none", None), "d": ("none", None), "e": ("partial", "m1")}


def ocr_case(spark, candidates, judges=(), paid=None, mode="ensemble"):
    c = spark.createDataFrame([("p", *x) for x in candidates],
                              "media_path string, provider string, ok boolean, text string, rate_limited boolean, dead boolean")
    j = spark.createDataFrame([("p", *x) for x in judges],
                              "media_path string, provider string, model string, ok boolean, text string, dead boolean")
    p = None if paid is None else spark.createDataFrame(
        [("p", *x) for x in paid], "media_path string, role string, model string, ok boolean, text string")
    r = enrich.choose_ocr(c, j, mode, p).first()
    return r.mode, r.model, r.text, r.status


def test_ocr_ladder(spark):
    g, m, n = [(p, True, f" {p} ", False, False) for p in ("gemini", "nim_gemma4", "nim_nemotron")]
    judge = [("gemini", "gm", True, "second", False), ("nim_gemma4", "g4", True, " JUDGED ", False)]
    assert ocr_case(spark, [n, m, g], judge) == ("ensemble", "ensemble(judge=g4)", "JUDGED", "ok")
    assert ocr_case(spark, [n, m], [(*judge[1][:4], True), judge[0]])[1] == "ensemble(judge=gm)"
    assert ocr_case(spark, [n, m]) == ("solo", "solo(nim_gemma4)", "nim_gemma4", "ok")
    assert ocr_case(spark, [n, g], judge, mode="solo")[1] == "solo(gemini)"
    bought = [("judge", "big", True, "J"), ("ocr", "big", True, "O")]
    assert ocr_case(spark, [n, m], [], bought)[:2] == ("paid_judge", "paid_judge(big)")
    limited = [(p, False, None, True, False) for p in ("gemini", "nim_gemma4")]
    spent = [(p, False, None, False, True) for p in ("gemini", "nim_gemma4")]
    assert ocr_case(spark, limited, [], bought)[3] == "failed"
    assert ocr_case(spark, spent, [], bought)[:3] == ("paid_solo", "paid_solo(big)", "O")
    assert ocr_case(spark, spent)[3] == "failed"


@pytest.mark.parametrize("calls, want", [
    ([("t", 429, None), ("v", 200, None)], ("v3", "ok")), ([("t", 429, None), ("v", 429, 61)], (None, "rate_limited")),
    ([("t", 429, 5), ("t", 200, None)], ("turbo", "ok")), ([("t", 429, 61), ("v", 200, None)], ("v3", "ok")),
    ([("t", 500, None), ("v", 200, None)], (None, "error")), ([("t", 429, 5), ("t", 500, None), ("v", 200, None)], (None, "error")),
    ([("t", 429, 5), ("t", 429, 5), ("v", 200, None)], ("v3", "ok")), ([("l", 200, None)], ("local", "ok")),
    ([("l", 500, None), ("t", 200, None)], ("turbo", "ok"))])
def test_transcription_ladder(spark, calls, want):
    names = {"t": ("groq", "whisper-large-v3-turbo"), "v": ("groq", "whisper-large-v3"), "l": ("local", "large-v3")}
    rows = [("m", *names[c], i, s, r, " text ") for i, (c, s, r) in enumerate(calls)]
    df = spark.createDataFrame(rows, "media_path string, backend string, model string, seq long, status int, "
                                     "retry_after int, text string")
    r = enrich.choose_transcript(df).first()
    short = {"whisper-large-v3-turbo": "turbo", "whisper-large-v3": "v3", "large-v3": "local", None: None}[r.model]
    assert (short, r.error or r.status) == want


def test_uploads(spark):
    mb = 1024 * 1024
    rows = [("a.mp3", mb, None), ("a.mp4", mb, mb), ("a.mp3", 30 * mb, 26 * mb), ("a.wma", mb, mb), ("a.mp4", mb, None)]
    df = spark.createDataFrame(rows, "path string, size_bytes long, extracted_bytes long")
    assert [r.action for r in enrich.precheck_upload(df, True).collect()] == ["upload", "extract", "skip", "extract", "skip"]
    assert [r.skip_reason for r in enrich.precheck_upload(df, False).collect()] == [None] + ["no_ffmpeg"] * 4


def test_provider_failures_stay_rows(spark):
    def fn(batch):
        if (batch["i"] == 3).any():
            raise RuntimeError("token=abc")
        for i in batch["i"]:
            yield {"twice": int(i) * 2}

    got = {r.i: r for r in enrich.apply_provider(spark.range(6).withColumnRenamed("id", "i"), fn, "twice bigint", ["abc"]).collect()}
    assert (got[3].status, got[3].error, got[3].twice) == ("failed", "RuntimeError: token=***REDACTED***", None)
    assert [got[i].twice for i in (0, 1, 2, 4, 5)] == [0, 2, 4, 8, 10]


def test_titles_per_platform(spark):
    rows = docs(spark, [("s", "web", [], None)])
    for meta, want in [({}, "# web 포스트 (s)"), ({"author": "me"}, "# @me — web 포스트 (s)"),
                       ({"author": "me", "code": "C"}, "# @me — web 포스트 (C)"), ({"title": "T"}, "# web 포스트 (s)")]:
        one = rows.withColumn("meta", schema.meta(**{k: F.lit(v) for k, v in meta.items()}))
        assert output.render_markdown(one).first().markdown.split("\n")[0] == want
    info = spark.createDataFrame([("u", '{"id": "x", "title": "T", "uploader": "up", "description": "d"}')], "source string, info string")
    assert output.render_markdown(video.normalize_youtube(info)).first().markdown.startswith("# youtube 포스트 (u)\n")


def test_html_files_are_whole_captures(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one</p>\n<p>two</p>\n")
    (tmp_path / "b.html").write_text('{"html": "<p>x</p>", "finalUrl": "https://f/"}')
    got = {r.url.rsplit("/", 1)[-1]: (r.body, r.final_url) for r in captures.load_captures(spark, str(tmp_path), "html").collect()}
    assert got["a.html"][0] == "<p>one</p>\n<p>two</p>\n" and got["b.html"] == ("<p>x</p>", "https://f/")


def test_provider_sees_each_row_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def fn(batch):
        for i in batch["i"]:
            with open(seen, "a") as f:
                f.write(f"{i}\n")
            if i % 4 == 1:
                raise RuntimeError("bad")
            yield {"twice": int(i) * 2}

    def whole(batch):
        if (batch["i"] == 2).any():
            raise RuntimeError("bad")
        return [{"twice": int(i) * 2} for i in batch["i"]]

    rows = spark.range(0, 12, 1, 1).withColumnRenamed("id", "i")
    got = {r.i: r.status for r in enrich.apply_provider(rows, fn, "twice bigint").collect()}
    assert got == {i: "failed" if i % 4 == 1 else "ok" for i in range(12)}
    assert sorted(open(seen).read().split(), key=int) == [str(i) for i in range(12)]
    got = {r.i: r.status for r in enrich.apply_provider(rows, whole, "twice bigint").collect()}
    assert got == {i: "failed" if i == 2 else "ok" for i in range(12)}


def test_union_loses_no_record(spark):
    base = docs(spark, [("s", "web", ["x.jpg"], None), ("s", "web", ["y.jpg"], None), ("t", "web", [], None)])
    union = timeline.union_documents(base, base.filter("source = 't'").withColumns({"part_no": F.lit(None).cast("int")}))
    assert output.render_markdown(union).count() == 4
    ocr = spark.createDataFrame([("x.jpg", "X", "m", "ok")], "media_path string, text string, model string, status string")
    got = sorted((r.source, r.media_paths, [o.text for o in r.ocr_text], r.meta.ocr_label) for r in enrich.enrich_ocr(union, ocr).collect())
    assert got == [("s", ["x.jpg"], ["X"], "done"), ("s", ["y.jpg"], [], "failed"), ("t", [], [], "none"), ("t", [], [], "none")]


def test_nothing_is_cut_by_default(spark):
    viewer = spark.createDataFrame([("p", i, f"https://a/{i}.jpg") for i in range(100)], "post_id string, pos int, url string")
    assert timeline.select_images(viewer, viewer.limit(0)).count() == 100
    assert timeline.select_images(viewer, viewer.limit(0), max_photos=80).count() == 80
    articles = spark.createDataFrame([("p", 0, "body", None, None), ("p", 1, "x" * 5000, None, None)],
                                     "post_id string, pos int, text string, aria_label string, caption string")
    assert len(timeline.comment_candidates(articles).first().raw_text) == 5000
    cut = timeline.comment_candidates(articles, max_chars=10).first()
    assert (cut.raw_text, cut.text_cut) == ("x" * 10, True)


def test_rendering(spark, tmp_path):
    base = docs(spark, [("s", "web", ["/a/b/../x.png", "rel.mp4"], "spoken")])
    comments = F.array(
        schema.comment(author=F.lit("u"), text=F.lit("a\nb"), likes=F.lit(3)), schema.comment(text=F.lit("c")))
    df = base.withColumn("platform", F.lit("threads")).withColumn("comments", comments).withColumn(
        "ocr_text", F.array(F.struct(F.lit("/m/x.png").alias("media_path"), F.lit("o\np").alias("text"), F.lit("m").alias("model"))))
    df = df.withColumn("meta", schema.meta(
        author=F.lit("me"), code=F.lit("C"), likes=F.lit(7), reply_count=F.lit(9), media_complete=F.lit(False),
        completeness=F.struct(*[F.lit(v).alias(n) for n, v in (
            ("root_found", True), ("expected", 9), ("captured", 2), ("incomplete", True), ("scrape_mode", "fast"),
            ("max_pages", None))]),
        fetched_at=F.lit("2024-01-02 03:04:05.000006").cast("timestamp")))
    want = (
        "# @me — threads 포스트 (C)\n\nb\n\n## 댓글 (2개 수집 / 전체 ~9)\n\n- **u** ♥3: a b\n- **(익명)**: c\n\n## 미디어\n\n"
        "- /a/x.png\n- /w/rel.mp4\n\n## 이미지 속 텍스트 (OCR)\n\n> x.png: o p\n\n## 전사\n\nspoken\n\n---\n플랫폼: threads · 좋아요: 7 · "
        "수집: 2024-01-02T03:04:05.000006+00:00 · 완전성: 부분수집(2/9) · 미디어 일부 누락\n")
    assert output.render_markdown(df, base_dir="/w").first().markdown == want
    relative = output.render_markdown(df, "relative", "/a/c", "/w").first().markdown
    assert "- ../x.png\n- ../../w/rel.mp4\n" in relative
    plain = output.render_markdown(docs(spark, [("s", "web", [], None)])).first().markdown
    assert plain == "# web 포스트 (s)\n\nb\n\n---\n플랫폼: web · 완전성: 완전수집\n"
    marked = str(tmp_path / "marked")
    output.write_documents(df, marked, "markdown", base_dir="/w")
    back = spark.read.json(marked).first()
    assert (back.source, back.platform, back.section, back.part_no, back.markdown) == ("s", "threads", 1, 0, want)
    path = str(tmp_path / "out")
    output.write_documents(df, path)
    back = json.loads(spark.read.text(path).first().value)
    assert set(back) == set(schema.ENVELOPE) and back["comments"][1]["author"] is None
    with pytest.raises(Exception):
        output.write_documents(df, path)
