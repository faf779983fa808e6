import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.operators import urls


def column(df, name, key="id"):
    return {r[key]: r[name] for r in df.collect()}


def frame(spark, values, name="url"):
    return spark.createDataFrame(list(enumerate(values)), f"id long, {name} string")


def test_routing(spark):
    df = frame(spark, [
        "https://youtube.com", "https://a.b.youtube.com/x", "youtube.com/watch", "  ", None, "https://m.youtube.com/x",
        "http://blog.naver.com/a", "HTTPS://WWW.TIKTOK.COM/@a", "é.youtube.com/x", "ftp://x/"])
    files = spark.createDataFrame([("youtube.com/watch",)], "path string")
    got = urls.route_urls(df, "url", files)
    assert column(got, "platform") == {
        0: "web", 1: "web", 2: "local", 3: None, 4: None, 5: "youtube", 6: "naver_blog", 7: "tiktok", 8: "youtube",
        9: None}
    assert column(got, "route_error")[3] == "empty" and column(got, "route_error")[9] == "unsupported"


def test_keys(spark):
    df = spark.createDataFrame([
        (0, "dQw4w9WgXcQ", "youtube"), (1, "https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "youtube"),
        (2, "https://evil.com/?v=dQw4w9WgXcQ", "youtube"), (3, "https://threads.net/@a..b/post/C", "threads"),
        (4, "https://blog.naver.com/PostView.naver?blogId=me&logNo=12", "naver_blog"),
        (5, "https://blog.naver.com/PostList/12", "naver_blog"), (6, "https://blog.naver.com/me", "naver_blog"),
        (7, "zuck", "facebook"), (8, "https://evil.com/x", "facebook"),
        (9, "https://www.youtube.com/" + "x" * 2100, "youtube"), (10, "http://h/p", "web"), (11, "http:///p", "web"),
    ], "id long, url string, platform string")
    got = {r.id: r for r in urls.parse_post_keys(df).collect()}
    assert [got[i].key for i in range(9)] == [
        "dQw4w9WgXcQ", "dQw4w9WgXcQ", None, None, "me", None, "me", "https://www.facebook.com/zuck", None]
    assert (got[4].log_no, got[6].log_no, got[6].kind, got[7].kind) == ("12", None, "blog", "profile")
    assert got[9].key_error == "too_long" and got[10].key == "http://h/p" and got[11].key_error == "no_key"


def test_variants(spark):
    df = frame(spark, ["https://www.example.com/a", "https://example.com/", "https://www.x.com:80/?q#f"])
    rows = [(r.id, r.transform, r.variant_url) for r in urls.expand_url_variants(df).collect()]
    assert (0, "mobile_subdomain", "https://m.example.com/a") in rows
    assert (1, "am_prefix", "https://m.example.com/") in rows
    assert (2, "drop_www", "https://x.com/?q#f") in rows and (2, "mobile_subdomain", "https://m.x.com:80/?q#f") in rows
    try:
        urls.expand_url_variants(df, order=["nope"])
        raise AssertionError("an unknown transform must fail")
    except ValueError:
        pass


def test_redaction(spark):
    df = spark.createDataFrame([(0, "http://x/a?k=s", "my s")], "id long, url string, note string")
    row = urls.redact_urls(df, ["url"], {"note": "s", "url": ""}, marker=True).first()
    assert row.url == "http://x/a ?…redacted…" and row.note == "my ***REDACTED***"


def test_guard(spark):
    blocked = ["http://127.0.0.1/", "http://169.254.169.254/x", "http://10.0.0.1", "http://192.168.1.1:80/",
               "http://172.16.0.1/", "http://[::1]/", "http://0.0.0.0/", "ftp://a/", "file:///etc", "http://localhost/",
               "http://[::ffff:10.0.0.1]/", "http://[fe80::1]/", "http://224.0.0.1/"]
    allowed = ["http://1.1.1.1/", "https://8.8.8.8/", "http://unknown.example/", "http://172.32.0.1/",
               "http://[2606:4700::1]/"]
    resolved = spark.createDataFrame([("localhost", "127.0.0.1"), ("localhost", "8.8.8.8")], "host string, ip string")
    got = column(urls.guard_urls(frame(spark, blocked + allowed), "url", resolved), "is_safe")
    assert [got[i] for i in range(len(blocked))] == [False] * len(blocked)
    assert [got[i] for i in range(len(blocked), len(got))] == [True] * len(allowed)
    # Rows may carry maps, and a missing URL is not safe.
    mapped = frame(spark, ["http://localhost/", None]).withColumn("headers", F.create_map(F.lit("a"), F.lit("b")))
    rows = urls.guard_urls(mapped, "url", resolved).orderBy("id").collect()
    assert [(r.is_safe, r.reason) for r in rows] == [
        (False, "resolves_internal:localhost->127.0.0.1"), (False, "scheme:none")]
    private = urls.guard_urls(frame(spark, ["http://127.0.0.1:8080/"]), allow_private=True).first()
    assert (private.is_safe, private.reason) == (True, "allow_private")


def test_redirects(spark):
    hops = spark.createDataFrame([
        ("http://a/", 302, "http://169.254.169.254/"), ("http://b/", 302, "http://1.1.1.1/landing"),
        ("http://1.1.1.1/landing", 200, None), ("http://loop/", 301, "http://loop/"),
        ("http://c/x/y", 302, "../z?q=1"), ("http://c/z?q=1", 200, None), ("http://d/", 302, None),
    ], "url string, status int, location string")
    starts = frame(spark, ["http://a/", "http://b/", "http://loop/", "http://c/x/y", "http://d/", "http://none/"])
    got = {r.url: r for r in urls.resolve_redirects(starts, hops, 3).collect()}
    assert got["http://a/"].error == "ssrf_redirect_blocked:ip_blocked:169.254.169.254"
    assert (got["http://b/"].final_url, got["http://b/"].status, got["http://b/"].hops) == (
        "http://1.1.1.1/landing", 200, 1)
    assert got["http://loop/"].error == "too_many_redirects"
    assert got["http://c/x/y"].final_url == "http://c/z?q=1"
    assert got["http://d/"].status == 302 and got["http://none/"].error == "not_captured"


def random_addresses(rng, n):
    """Addresses of both versions, many of them near the edges of special blocks, in all spellings."""
    edges = [ipaddress.ip_network(x) for x in (*rules.BLOCKED_IPV4, *rules.BLOCKED_IPV6, *rules.PUBLIC_NETWORKS, "64:ff9b::/96", "100::/64", "fc00::/7", "fe80::/10",
                                               "ff00::/8", "::1/128", "::/128", "::ffff:0:0/96", "fe00::/9", "1000::/4", "e000::/4")]
    out = []
    for _ in range(n):
        net = rng.choice(edges)
        kind = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        top = (1 << (32 if net.version == 4 else 128)) - 1
        number = rng.choice([rng.randint(0, top), int(net.network_address) + rng.randint(0, 3), int(net.broadcast_address) + rng.randint(-2, 2),
                             rng.randint(int(net.network_address), int(net.broadcast_address))])
        address = kind(min(top, max(0, number)))
        out.append(rng.choice([str(address), address.exploded, str(address) + ("%eth0" if net.version == 6 else "")]))
        if net.version == 4:
            out.append(rng.choice(["::ffff:", "0:0:0:0:0:ffff:", "64:ff9b::", "1::"]) + str(address))
    return out


NO_ADDRESS = ["", "1.2.3", "1.2.3.256", "01.2.3.4", "a:b:c", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", ":1", "1:", "::g", "h.example",
              "1:2:3:4::5:6:7:8", "::1.2.3.999", "1.2.3.4:80"]


def test_addresses_equal_the_standard_library(spark):
    texts = random_addresses(random.Random(5), 1500) + NO_ADDRESS
    got = column(urls.with_blocked(frame(spark, texts, "ip").repartition(3), "ip", "bad"), "bad")
    for i, text in enumerate(texts):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            assert got[i] is False, text
            continue
        ip = getattr(ip, "ipv4_mapped", None) or ip
        want = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified
        assert got[i] == want, text


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_any_list_of_networks(spark, broadcast):
    rng = random.Random(6)
    nets = {}
    while len(nets) < 300:
        version = rng.choice([4, 6])
        bits = 32 if version == 4 else 128
        base = rng.choice([0x0A000000, 0xC0A80000, 0x08080000]) if version == 4 else rng.choice([0x20010DB8 << 96, 0x2606 << 112, 0])
        length = rng.randint(0, bits) if rng.random() < 0.1 else rng.randint(bits // 4, bits)
        address = (ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address)(base + rng.getrandbits(rng.randint(1, bits // 2)))
        nets[ipaddress.ip_network((address, length), strict=False)] = rng.random() < 0.6
    texts = NO_ADDRESS + random_addresses(rng, 200)
    for net in nets:
        texts += [str(net[0]), str(net[-1]), str(net[rng.randint(0, net.num_addresses - 1)])]
    table = spark.createDataFrame([(str(n), f) for n, f in nets.items()] + [("nonsense", True), ("1.2.3.4/99", True), (None, True)], "network string, blocked boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = column(urls.with_blocked(frame(spark, texts, "ip").repartition(3), "ip", "bad", table), "bad")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for i, text in enumerate(texts):
        try:
            ip = ipaddress.ip_address(text.split("%")[0])
        except ValueError:
            assert got[i] is False, text
            continue
        ip = getattr(ip, "ipv4_mapped", None) or ip
        inside = [n for n in nets if n.version == ip.version and ip in n]
        assert got[i] == (nets[max(inside, key=lambda n: n.prefixlen)] if inside else False), text


def test_guard_with_networks_of_the_caller(spark):
    nets = spark.createDataFrame([("8.8.0.0/16",), ("2606:4700::/32",)], "network string")
    resolved = spark.createDataFrame([("dns", "8.8.4.4"), ("dns6", "2606:4700::5"), ("home", "10.0.0.1")], "host string, ip string")
    got = column(urls.guard_urls(frame(spark, ["http://8.8.8.8/", "http://10.0.0.1/", "http://dns/", "http://dns6/", "http://home/", "http://[2606:4700::1]:80/"]),
                                 "url", resolved, networks=nets), "reason")
    assert list(got.values()) == ["ip_blocked:8.8.8.8", "public_ip", "resolves_internal:dns->8.8.4.4", "resolves_internal:dns6->2606:4700::5", "public",
                                  "ip_blocked:2606:4700::1"]


@pytest.mark.parametrize("limit", [0, 1, 2, 5, 10])
def test_redirects_like_one_fetch_after_the_other(spark, limit):
    rng = random.Random(limit)
    names = [f"http://h{i}/" for i in range(60)]
    table = {}
    for i, name in enumerate(names[:55]):
        # Long chains, loops, dead ends, blocked targets.
        target = rng.choice([names[min(59, i + 1)]] * 6 + [rng.choice(names), "http://10.0.0.1/", None])
        table[name] = (rng.choice([301, 302, 302, 307, 200]), target)

    def follow(url):
        hops = 0
        for _ in range(limit + 1):
            if url not in table:
                return None, hops, None, "not_captured"
            status, target = table[url]
            if status == 200 or target is None:
                return url, hops, status, None
            if "10.0.0.1" in target:
                return None, hops, None, "ssrf_redirect_blocked:ip_blocked:10.0.0.1"
            url, hops = target, hops + 1
        return None, hops, None, "too_many_redirects"

    hops = spark.createDataFrame([(u, s, t) for u, (s, t) in table.items()], "url string, status int, location string")
    starts = frame(spark, names * 2 + [None])
    got = urls.resolve_redirects(starts, hops, limit).collect()
    assert len(got) == 121
    for r in got:
        assert (r.final_url, r.hops, r.status, r.error) == (follow(r.url) if r.url else (None, None, None, None)), r.url


def test_join_like_the_standard_library(spark):
    from urllib.parse import urljoin

    cases = [("http://h/a/b?x#f", t) for t in (
        "c", "./c", "../c", "../../c", "/c/./d/../e", "//o/p", "?y", "#g", "https://z/", "c/", "..", "../", "a?b/../c")]
    df = spark.createDataFrame(cases, "base string, location string")
    for r in df.select("*", urls.absolute_url(F.col("base"), F.col("location")).alias("u")).collect():
        assert r.u == urljoin(r.base, r.location), (r.location, r.u)


def test_locale(spark):
    df = frame(spark, ["ko-KR", "en_US.UTF-8", "Korean_Korea", "ja", "C", "1234", "", None], "loc")
    got = column(urls.normalize_lang(df, "loc", "??"), "lang_code")
    assert [got[i] for i in range(8)] == ["ko", "en", "ko", "ja", "??", "??", "??", "??"]


def test_host_batches_keep_order_and_split(spark):
    df = spark.range(1000).select(
        F.col("id").alias("position"), F.when(F.col("id") % 3 > 0, "http://hot/").otherwise("http://cold/").alias("url"))
    batched = urls.batch_by_host(df, n=4).withColumn("p", F.spark_partition_id())
    rows = batched.collect()
    assert len(rows) == 1000 and len({r.p for r in rows if r.host == "hot"}) > 1
    for p in {r.p for r in rows}:
        part = [(r.host, r.position) for r in rows if r.p == p]
        assert part == sorted(part)
