"""Plan shapes that must hold at any size."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from pagemill.functions import ordered, parts
from pagemill.operators import blog, fetchlog, quality, threads, urls
from pagemill.plans import group_a, group_b, group_c, group_d, group_e, group_f

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OWN = {n for g in (group_a, group_b, group_c, group_d, group_e, group_f) for n in g.QUERIES}
# These run jobs while they are built (rounds, streams, a written table).
EAGER = {n for n in OWN if n.startswith(("a9", "d1_", "d2", "d3", "d7", "g2")) or n.endswith("_stream")}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(OWN - EAGER))
def test_no_all_pairs_and_no_python(spark, name):
    text = plan(spark_entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Only the caller's own function runs in Python.
    assert ("MapInPandas" in text) == (name == "f2_apply_provider")
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
def test_pages_are_not_shuffled(spark):
    for name in ("b1_extract_text", "b2_extract_og", "b3_extract_paragraphs", "b4_extract_media_urls", "b5_validate_pages",
                 "b6_match_selectors", "b7_detect_waf", "b8_detect_shell", "b11_scan_injection", "b12_wrap_untrusted",
                 "b13_scan_lines", "b14_extract_embedded_json", "a4_parse_post_keys", "a5_official_routes",
                 "a6_expand_url_variants", "e20_parse_comments", "e21_comments_label"):
        assert "Exchange" not in plan(spark_entry.queries()[name](spark, SF_DIR)), name


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
def test_only_needed_columns_are_read(spark):
    text = plan(spark_entry.queries()["e2_engagement"](spark, SF_DIR))
    assert "o_orderpriority" not in text and "o_totalprice" in text


def hot(spark, n=20000):
    """A table of which one key holds two thirds, read as if large: no broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.col("id").alias("seq"))


def largest_share(df, value):
    """Share of the rows in the fullest partition.  ``value`` is read, else the optimizer leaves its join out."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("count"), F.max(value)).collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture
def no_coalescing(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_key_is_spread(spark, no_coalescing):
    df = hot(spark)
    chunk = ordered.chunk_of("seq", 250)
    # Without adaptive help: the fullest of 16 tasks stays far below the hot key's two thirds.
    assert largest_share(ordered.ordered_values(df, ["key"], ["seq"], chunk, {"n": F.lit(1)}), "n") < 0.3
    assert largest_share(ordered.group_values(df, ["key"], {"m": ("max", F.col("seq"))}, chunk), "m") < 0.3
    store = df.select("key").distinct().withColumn("v", F.length("key"))
    assert largest_share(ordered.lookup(df, store, ["key"]), "v") < 0.3
    children = parts.in_parts(df, "key", "seq", F.col("seq"), "children", 250)
    whole = parts.attach_parts(store, children, "key")
    assert largest_share(whole, "v") < 0.3 and whole.agg(F.sum(F.size("children"))).first()[0] == 20000
    assert whole.agg(F.max(F.size("children"))).first()[0] <= 250


def repeated(spark, n=20000, **columns):
    """Rows of which two thirds are equal in every column; ``i`` in an expression tells the others apart."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    base = spark.range(n).withColumn("i", F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")))
    return base.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def test_equal_rows_are_spread(spark, no_coalescing):
    requests = repeated(spark, url="concat('https://h', i, '.example.com/p')", device="'mobile'")
    store = requests.select(fetchlog.route_key(F.col("url"), F.col("device")).alias("key")).distinct().withColumn("route", F.lit("r"))
    assert largest_share(fetchlog.lookup_routes(requests, store), "route") < 0.3
    inputs = repeated(spark, url="concat('/data/', i)")
    assert largest_share(urls.route_urls(inputs, local_paths=inputs.select(F.col("url").alias("path"))), "platform") < 0.3
    guarded = repeated(spark, url="concat('https://h', i, '.example.com/p')")
    hosts = guarded.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), F.lit("8.8.8.8").alias("ip")).distinct()
    assert largest_share(urls.guard_urls(guarded, resolved=hosts), "reason") < 0.3
    posts = repeated(spark, blog_id="'b'", log_no="CAST(i + 5 AS STRING)", og_title="''")
    listing = posts.select("blog_id", "log_no").distinct().withColumns({
        **{c: F.lit("x") for c in ("title_with_inspect", "title", "add_date", "category")},
        **{c: F.lit(1) for c in ("comment_count", "read_count", "sympathy_count", "like_count")}})
    assert largest_share(blog.join_listing(posts, listing), "like_count") < 0.3
    static = repeated(spark, 6000, url="concat('https://h', i, '.example.com')", html="'<div id=root></div>'", verdict="'weak_ok'", ok="true")
    shots = static.select("url", F.lit("<p>text</p>").alias("html")).distinct()
    assert largest_share(quality.merge_renderings(static, shots, "always"), "body_text") < 0.3


def test_lookup_finds_what_a_join_finds(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 2), ("b", 3), ("c", 4)], "k string, n int")
    table = spark.createDataFrame([("a", "A"), ("b", "B"), ("d", "D")], "k string, v string")
    got = sorted((repr(r.k), r.n, r.v) for r in ordered.lookup(df, table, ["k"]).collect())
    assert got == sorted((repr(r.k), r.n, r.v) for r in df.join(table, "k", "left").collect())


def test_lookup_deals_rows_alike_in_any_order(spark, no_coalescing):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    table = spark.createDataFrame([("hot", "A")], "k string, v string")
    rows = [("hot" if i % 5 else None, i, {"a": str(i)}) for i in range(500)]

    def dealt(given):
        df = ordered.lookup(spark.createDataFrame(given, "k string, n int, m map<string,string>").coalesce(1), table, ["k"])
        return {r.n: r.p for r in df.select("n", "v", F.spark_partition_id().alias("p")).collect()}

    first = dealt(rows)
    assert len(first) == 500 and len(set(first.values())) > 8 and first == dealt(rows[::-1])


def test_group_aggregates_are_combined_first(spark, no_coalescing):
    df = hot(spark)
    posts = df.select(
        F.col("key").alias("thread_id"), F.lit("c0").alias("root_code"), "seq", F.concat(F.lit("c"), "seq").alias("code"),
        F.lit(1).cast("long").alias("reply_count"))
    attempts = df.select(
        F.hash("key").cast("long").alias("request_id"), "seq", F.lit("grid").alias("phase"), F.lit("u").alias("url"),
        F.lit("blocked").alias("verdict"), F.lit(None).cast("string").alias("error"))
    for result in (threads.assess_completeness(posts), fetchlog.resolve_attempts(attempts)):
        assert "partial_" in plan(result) and "collect_list" not in plan(result)


def test_media_meet_their_winners_by_post_alone(spark):
    """Media are shuffled as the posts they lie in, and once as base URLs; only what won is regrouped."""
    from pagemill.operators import timeline

    posts = spark.range(200).select(
        (F.col("id") % 3).alias("profile"), F.col("id").alias("post_seq"),
        F.array(F.concat(F.lit("a"), F.col("id") % 5, F.lit("?1")), F.concat(F.lit("a"), F.col("id") % 5, F.lit("?2"))).alias("image_urls"),
        F.array(F.concat(F.lit("v"), F.col("id") % 4), F.lit(None).cast("string")).alias("video_urls"))
    # A post met twice has the media of both.
    posts = posts.unionByName(posts.filter("post_seq = 0").withColumn("image_urls", F.array(F.lit("z"), F.lit("a0?3"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = timeline.dedup_media_across_posts(posts)
        text = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert not [line for line in text.splitlines() if "Exchange hashpartitioning(profile" in line and "post_seq" in line and "kind" in line]
        rows = done.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = {(p, k): min(i for i in range(200) if i % 3 == p and i % 5 == k) for p in range(3) for k in range(5)}
    for r in rows:
        if r.post_seq == 0:
            assert r.images_to_fetch == ["a0?1", "z"]
        else:
            k = r.post_seq % 5
            assert r.images_to_fetch == ([f"a{k}?1"] if first[(r.profile, k)] == r.post_seq else [])
