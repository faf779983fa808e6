import json
import random

from pyspark.sql import functions as F

from pagemill.functions.lineage import bucketed
from pagemill.operators import output, threads

POST = ("thread_id long, source string, root_code string, seq long, id string, code string, author string, text string, "
        "likes long, reply_count long, images array<string>, videos array<string>, downloaded array<string>")


def payloads(spark, *objects):
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "n long, body string")
    return df.select("n", F.parse_json("body").alias("payload"))


def test_posts_at_any_depth(spark):
    deep = {"a": {"post": {"id": "deep"}}}
    for _ in range(30):
        deep = {"x": [deep]}
    df = payloads(
        spark, {"post": {"id": "1", "in": {"post": {"id": "2"}}}, "relatedPosts": {"post": {"id": "no"}}},
        {"post": 5, "related_posts": [{"post": {"id": "no"}}], "l": [{"post": {"id": "3"}}, {"post": [1]}]}, deep)
    got = threads.iter_thread_posts(df).select("n", "path", F.try_variant_get("post", "$.id", "string").alias("id"))
    assert sorted((r.n, r.id) for r in got.collect()) == [(0, "1"), (0, "2"), (1, "3"), (2, "deep")]
    cut = threads.iter_thread_posts(df, max_depth=10).filter("reject_reason is not null").collect()
    assert [(r.n, r.reject_reason) for r in cut] == [(2, "too_deep")]


def walked(node, blocked, path=()):
    """Depth first over what a JSON parser returns."""
    out = []
    for i, (key, value) in enumerate(node.items() if isinstance(node, dict) else [(None, v) for v in node]):
        if key in blocked or not isinstance(value, (dict, list)):
            continue
        if key == "post" and isinstance(value, dict):
            out.append(([*path, i], value))
        out += walked(value, blocked, (*path, i))
    return out


def test_posts_equal_a_parser_in_order_of_the_text(spark):
    rng = random.Random(17)
    names = ["post", "post", "a", "zz", "relatedPosts", "related_posts", 'q"post', "b\\", "po\u0073t", "é"]

    def value(depth):
        kind = rng.random()
        if depth > 5 or kind < 0.25:
            return rng.choice([1, 2.50, None, True, "post", 'x"post": {', "{[,", "\\", ""])
        if kind < 0.5:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(names): value(depth + 1) for _ in range(rng.randint(0, 4))}

    texts = [json.dumps({"r": value(0), "s": [value(0)]}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(400)]
    # Keys that come twice: the last value at the place of the first.
    texts += ['{"post": {"a": 1}, "b": {"post": {}}, "post": {"c": {"post": {"d": 1}}}}', '{"x": [{"post": {"n": 1}}], "x": 5}', '{"p\\u006fst": {"u": 1}}',
              "[]", "5", '"post"', "not json", None, '{"post": {"big": 12345678901234567890, "z": 1.10, "a": 1e5}}']
    df = spark.createDataFrame(list(enumerate(texts)), "n long, payload string").repartition(3)
    got = {}
    for r in threads.iter_thread_posts(df).select("n", "path", F.to_json("post").alias("post"), "reject_reason").collect():
        assert r.reject_reason is None
        got.setdefault(r.n, []).append((r.path, json.loads(r.post)))
    for n, text in enumerate(texts):
        try:
            node = json.loads(text)
        except (TypeError, ValueError):
            node = None
        want = walked(node, {"relatedPosts", "related_posts"}) if isinstance(node, (dict, list)) else []
        assert sorted(got.get(n, []), key=lambda p: p[0]) == want, text
    assert threads.iter_thread_posts(df.limit(0)).collect() == []


def test_payloads_are_scanned_once(spark):
    df = spark.createDataFrame([(1, '{"a": ' * 400 + '{"post": {"id": "x"}}' + "}" * 400)], "n long, payload string")
    plan = threads.iter_thread_posts(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") >= 1
    assert threads.iter_thread_posts(df).count() == 1


def test_parsing(spark):
    user = {"username": "u"}
    df = payloads(
        spark, {"post": {"id": "a", "user": user, "caption": {"text": "t"}}},
        {"post": {"id": "b", "user": user, "caption": None, "like_count": None, "image_versions2": {
            "candidates": [{"url": "x", "width": 5}, {"url": "y", "width": 5}, {"url": "", "width": 9}]}}},
        {"post": {"id": "c", "user": user, "caption": {"text": "t"}, "text_post_app_info": None}},
        {"post": {"id": "d", "caption": {"text": "t"}}}, {"post": {"id": "e", "user": user}},
        {"post": {"id": "f", "user": user, "carousel_media": [
            {"video_versions": [{"url": "v", "width": None}], "image_versions2": {"candidates": [{"url": "c"}]}},
            {"image_versions2": {"candidates": [{"url": "i"}]}}, {"image_versions2": {"candidates": [{"url": "i"}]}}]}})
    got = {r.id: r for r in threads.parse_posts(threads.iter_thread_posts(df)).collect()}
    assert set(got) == {"a", "b", "f"}
    assert (got["a"].likes, got["a"].reply_count, got["b"].likes, got["b"].images) == (0, 0, None, ["y"])
    assert (got["f"].images, got["f"].videos) == (["i"], ["v"])


def thread(n, root=True):
    rows = [(1, "s", "k0", i, f"p{i}", f"k{i}" if i or root else "other", f"a{i}", f"t\n{i}", i, 3, ["i"], [],
             [f"/m/{i}.jpg"] if i % 2 else []) for i in range(n)]
    return rows


def test_parts_hold_the_whole_thread(spark):
    df = spark.createDataFrame(thread(25), POST).repartition(4)
    whole = threads.assemble_threads(df, downloaded=True)
    parts = threads.assemble_threads(df, downloaded=True, part_size=7).orderBy("part_no").collect()
    one = whole.first()
    assert len(parts) == 4 and [r.part_count for r in parts] == [4] * 4
    assert [c for r in parts for c in r.comments] == one.comments and len(one.comments) == 24
    assert [p for r in parts for p in r.media_paths] == one.media_paths
    assert parts[0].body_text == one.body_text and parts[1].body_text == ""
    assert one.meta.completeness.asDict()["incomplete"] is False and one.meta.extra["media_label"] == "partially_downloaded"
    # Rendered parts, in order, read like the whole.
    text = "".join(r.markdown for r in output.render_markdown(threads.assemble_threads(
        df, downloaded=True, part_size=7)).orderBy("section", "part_no").collect())
    assert text == output.render_markdown(whole).first().markdown


def test_thread_without_root(spark):
    got = threads.assemble_threads(spark.createDataFrame(thread(3, root=False), POST)).collect()
    assert [r.reject_reason for r in got] == ["root not found"]


def test_media_labels(spark):
    df = spark.createDataFrame(thread(3), POST)
    label = lambda d, w, p="threads": threads.media_label(d, w, p).first().media_label
    empty = df.withColumn("downloaded", F.array().cast("array<string>"))
    assert [label(df, False), label(df, True), label(empty, True)] == ["none", "partially_downloaded", "download_failed"]
    assert [label(df, True, "tiktok"), label(empty, True, "tiktok")] == ["downloaded", "download_failed"]


def test_crawl_like_a_queue(spark, monkeypatch):
    # Pages lead to pages; the budget cuts the queue at the same place.
    links = {"a": ["b", "c"], "b": ["d", "a"], "c": ["d", "e"], "d": ["f"], "e": ["g"], "f": [], "g": []}
    url = lambda c: f"https://www.threads.net/@u/post/{c}"
    posts = [(url(p), i, c, c, "u", 1, f"{p}>{c}") for p, cs in links.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(posts, "page_url string, seq long, id string, code string, author string, "
                                      "reply_count long, text string")
    starts = spark.createDataFrame([(1, url("a"))], "crawl_id long, url string")
    monkeypatch.setattr(threads, "MERGE_LEVELS", 2)
    for budget in (1, 2, 3, 4, 100, None):
        queue, seen, found = ["a"], [], {}
        while queue and (budget is None or len(seen) < budget):
            page = queue.pop(0)
            if page in seen:
                continue
            seen.append(page)
            for c in links[page]:
                found[c] = f"{page}>{c}"
                if c not in seen and c not in queue:
                    queue.append(c)
        merged, visited = threads.crawl_reach(starts, df, budget)
        assert {r.id: r.text for r in merged.collect()} == found
        assert visited.first().visited_pages == len(seen)


def test_visited_pages_are_not_shuffled_again(spark):
    rows = [(i % 7, f"https://x/{i}") for i in range(200)]
    seen = [bucketed(spark.createDataFrame(rows[k::2], "crawl_id long, url string"), "visited", "crawl_id", "url") for k in range(2)]
    posts = spark.createDataFrame([(1, i, "u", f"c{i}", 1) for i in range(20)], "crawl_id long, seq long, author string, code string, reply_count long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = threads._unseen(threads._leads(posts, ["seq"]), seen)
        assert fresh.count() == 20
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_escalation_and_merge(spark):
    fast = spark.createDataFrame(thread(2), POST)
    deep = spark.createDataFrame(thread(9), POST)
    other = fast.withColumn("thread_id", F.lit(2).cast("long"))
    got = threads.escalate(fast.unionByName(other), deep).groupBy("thread_id", "scrape_mode").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, "deep", 9), (2, "fast", 2)]
    seen = spark.createDataFrame([(1, 0, "x", "old"), (1, 1, "y", "b"), (1, 2, "x", "new"), (1, 3, None, "n")],
                                 "thread_id long, seq long, id string, text string")
    rows = threads.merge_posts(seen).orderBy("first_seq").collect()
    assert [(r.id, r.text, r.first_seq) for r in rows] == [("x", "new", 0), ("y", "b", 1)]
