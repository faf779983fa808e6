"""Routing, key parsing and URL work (A3-A11).  Everything but A8/A9 is a plain projection."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import ordered
from ..functions.lineage import cut, stored
from ..functions.text import (
    any_of, col, host_of, netloc_of, port_of, scheme_of, strip, truthy, url_base, with_netloc,
)


def host_rule(platform: str) -> str:
    host = dict(rules.PLATFORM_HOSTS)[platform]
    return rf"(?iU)^(?:https?://)?{host}/"


def platform_of(url: Column) -> Column:
    """Platform of a stripped URL: ordered host rules, then plain http(s), else null."""
    rule = F.when(url.rlike(host_rule(rules.PLATFORM_HOSTS[0][0])), rules.PLATFORM_HOSTS[0][0])
    for name, _ in rules.PLATFORM_HOSTS[1:]:
        rule = rule.when(url.rlike(host_rule(name)), name)
    return rule.when(url.rlike(r"(?i)^https?://"), "web")


def route_urls(df: DataFrame, url: str = "url", local_paths: DataFrame | None = None) -> DataFrame:
    """A3: ``platform`` and ``route_error`` per input.

    ``local_paths`` (one column ``path``) lists existing files; a listed path is local whatever it looks like.
    """
    text = strip(url)
    routed = df
    is_local = F.lit(False)
    if local_paths is not None:
        files = local_paths.select(F.col("path").alias("_path")).distinct().withColumn("_local", F.lit(True))
        routed = ordered.lookup(
            routed.withColumn("_path", col(url)), files, ["_path"])
        is_local = F.coalesce(F.col("_local"), F.lit(False))
    platform = F.when(is_local, "local").otherwise(platform_of(text))
    error = (
        F.when(is_local, None)
        .when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(platform.isNull(), "unsupported")
    )
    return routed.withColumn("platform", platform).withColumn("route_error", error).select(
        *df.columns, "platform", "route_error"
    )


def parse_post_keys(df: DataFrame, url: str = "url", platform: str = "platform") -> DataFrame:
    """A4: ``key``, ``author``, ``kind``, ``canonical_url`` and ``key_error`` per platform."""
    s, p = strip(url), col(platform)

    def part(pattern: str) -> Column:
        return truthy(F.regexp_extract(s, pattern, 1))

    def on(name: str) -> Column:
        return s.rlike(host_rule(name))

    bare, *in_url = [part(p) for p in rules.VIDEO_ID_PATTERNS]
    youtube = F.coalesce(bare, F.when(on("youtube"), F.coalesce(*in_url)))

    author = part(rules.THREAD_PATH)
    author_ok = ~(author.contains("..") | author.startswith(".") | author.endswith("."))
    thread_code = truthy(F.regexp_extract(s, rules.THREAD_PATH, 2))
    threads = F.when(on("threads") & author_ok, thread_code)

    instagram = F.when(on("instagram"), part(rules.PHOTO_PATH))

    raw = col(url)
    query_blog = truthy(F.regexp_extract(raw, rules.BLOG_QUERY, 1))
    query_log = truthy(F.regexp_extract(raw, rules.BLOG_LOG_QUERY, 1))
    path_blog = truthy(F.regexp_extract(raw, rules.BLOG_PATH, 1))
    path_ok = path_blog.isNotNull() & ~F.lower(path_blog).isin(rules.BLOG_PAGES)
    blog = F.coalesce(query_blog, F.when(path_ok, path_blog))
    log_no = F.coalesce(
        query_log, F.when(query_blog.isNull() & path_ok, truthy(F.regexp_extract(raw, rules.BLOG_PATH, 2))))

    is_url = raw.startswith("http://") | raw.startswith("https://")
    timeline = (
        F.when(is_url & raw.rlike(rules.TIMELINE_HOST), raw)
        .when(~is_url & raw.rlike(rules.PROFILE_NAME),
              F.concat(F.lit("https://www.facebook.com/"), raw))
    )
    tiktok = F.when(on("tiktok"), s)
    web = F.when(scheme_of(s).isin("http", "https") & (host_of(s) != ""), s)

    too_long = (p.isin("youtube", "threads", "instagram", "tiktok") & (F.length(s) > rules.MAX_URL)) | (
        (p == "web") & (F.length(s) > rules.MAX_WEB_URL))
    key = F.when(too_long, None)
    for name, value in [("youtube", youtube), ("threads", threads), ("instagram", instagram),
                        ("naver_blog", blog), ("tiktok", tiktok), ("facebook", timeline), ("web", web)]:
        key = key.when(p == name, value)
    out = df.withColumn("key", key)
    k = F.col("key")
    canonical = (
        F.when(k.isNull(), None)
        .when(p == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), k))
        .when(p == "threads", F.concat(F.lit("https://www.threads.net/@"), author, F.lit("/post/"), k))
        .when(p == "instagram", F.concat(F.lit("https://www.instagram.com/p/"), k, F.lit("/")))
        .when(p == "naver_blog", F.concat_ws("/", F.lit("https://blog.naver.com"), k, log_no))
        .otherwise(k)
    )
    kind = (
        F.when(k.isNull(), None)
        .when(p == "facebook", F.when(raw.rlike(rules.POST_MARKERS), "post").otherwise("profile"))
        .when(p == "naver_blog", F.when(log_no.isNull(), "blog").otherwise("post"))
        .when(p == "web", "page")
        .otherwise("post")
    )
    error = (
        F.when(k.isNotNull(), None)
        .when(too_long, "too_long")
        .when(p.isNull() | (p == "local"), "no_platform")
        .otherwise("no_key")
    )
    return (
        out.withColumn("author", F.when((p == "threads") & k.isNotNull(), author))
        .withColumn("log_no", F.when((p == "naver_blog") & k.isNotNull(), log_no))
        .withColumn("kind", kind)
        .withColumn("canonical_url", canonical)
        .withColumn("key_error", error)
    )


def official_routes(df: DataFrame, url: str = "url") -> DataFrame:
    """A5: public feed and embed addresses derived from a URL, one row per route in ``priority`` order."""
    u = col(url)
    host = F.regexp_replace(host_of(u), r"^www\.", "")
    is_reddit = host.contains("reddit.com") | (host == "redd.it")
    is_x = host.isin("x.com", "twitter.com") | host.endswith(".x.com") | host.endswith(".twitter.com")
    is_video = host.contains("youtube.com") | (host == "youtu.be")
    site = F.when(is_reddit, "reddit").when(is_x, "x").when(is_video, "youtube")

    def route(priority: int, name: str, target: Column) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("route"), target.alias("route_url"))

    base = F.regexp_replace(url_base(u), r"/+$", "")
    dot = F.when(base.contains("/comments/"), ".").otherwise("/.")
    status = F.regexp_extract(u, rules.STATUS_PATH, 1)
    handle = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*/+([^/?#]+)", 1)
    routes = (
        F.when(is_reddit, F.array(
            route(1, "rss", F.concat(base, dot, F.lit("rss"))), route(2, "json", F.concat(base, dot, F.lit("json")))))
        .when(is_x & (status != ""), F.array(
            route(1, "tweet-result", F.concat(
                F.lit(rules.TWEET_RESULT[0]), status, F.lit(rules.TWEET_RESULT[1]))),
            route(2, "oembed", F.concat(
                F.lit(rules.TWEET_EMBED[0]), status, F.lit(rules.TWEET_EMBED[1])))))
        .when(is_x & (handle != "") & ~F.lower(handle).isin(rules.NOT_A_HANDLE), F.array(
            route(1, "syndication-timeline", F.concat(
                F.lit(rules.PROFILE_TIMELINE), handle))))
        .when(is_video, F.array(route(1, "yt-dlp", u)))
    )
    return df.withColumn("site", site).withColumn("_r", F.explode_outer(routes)).filter("_r is not null").select(
        "*", "_r.*").drop("_r")


def _transform(name: str, u: Column) -> Column:
    host, port = host_of(u), port_of(u)
    www = host.startswith("www.")
    bare = F.substr(host, F.lit(5))
    if name == "original":
        return u
    if name == "mobile_subdomain":
        # Port 0 counts as no port.
        kept = F.when(port.try_cast("int") > 0, F.concat(F.lit(":"), port.try_cast("int").cast("string"))).otherwise("")
        return F.when(www, with_netloc(u, F.concat(F.lit("m."), bare, kept)))
    if name == "am_prefix":
        dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
        apex = (host != "") & ~host.startswith("m.") & ~www & (dots < 2)
        return F.when(apex, with_netloc(u, F.concat(F.lit("m."), host)))
    if name == "drop_www":
        return F.when(www, with_netloc(u, bare))
    raise ValueError(f"unknown URL transform: {name!r}")


def expand_url_variants(df: DataFrame, url: str = "url", order: list[str] | None = None) -> DataFrame:
    """One row per applicable transform; of equal results the first in ``order`` stays (no shuffle)."""
    order = order or ["original", "mobile_subdomain", "am_prefix", "drop_www"]
    made = F.array(*[
        F.struct(F.lit(i).alias("variant_no"), F.lit(n).alias("transform"), _transform(n, col(url)).alias("variant_url"))
        for i, n in enumerate(order)
    ])
    usable = F.filter(made, lambda v: v["variant_url"].isNotNull())
    urls = F.transform(usable, lambda v: v["variant_url"])
    first = F.filter(usable, lambda v, i: F.array_position(urls, v["variant_url"]) == i + 1)
    return df.withColumn("_v", F.explode_outer(first)).filter("_v is not null").select(*df.columns, "_v.*")


def redact_urls(df: DataFrame, cols: list[str], secrets: dict[str, str | None] | None = None,
                marker: bool = False) -> DataFrame:
    """Cut queries off URL columns; replace literal secrets in text columns (name -> secret)."""
    out = df
    for c in cols:
        base = url_base(c)
        note = F.when(F.col(c).contains("?"), " ?…redacted…").otherwise("")
        out = out.withColumn(c, F.concat(base, note) if marker else base)
    for c, secret in (secrets or {}).items():
        if secret:
            out = out.withColumn(c, F.replace(F.col(c), F.lit(secret), F.lit(rules.REDACTED)))
    return out


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _ipv4_number(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    return sum((F.get(octets, F.lit(i)).try_cast("long") * (256 ** (3 - i)) for i in range(1, 4)), F.get(octets, F.lit(0)).try_cast("long") * 256**3)


def with_address(df: DataFrame, ip: str) -> DataFrame:
    """Add ``_version`` (4, 6, or null for text that is no address), ``_hi`` and ``_lo``, the 128 bits as two longs.

    IPv4 fills the lower half alone; an IPv4 address mapped into IPv6 is one of IPv4.  A zone behind ``%`` is left out.
    """
    text = F.substring_index(F.col(ip), "%", 1)
    mapped = truthy(F.regexp_extract(text, r"^(?:0{0,4}:){2,6}ffff:(\d+\.\d+\.\d+\.\d+)$", 1))
    tail = F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    tail_number = F.when(tail.rlike(IPV4), _ipv4_number(tail))
    hexed = F.concat(F.left(text, F.length(text) - F.length(tail)), F.lower(F.hex(F.shiftright(tail_number, 16))), F.lit(":"), F.lower(F.hex(tail_number.bitwiseAND(0xFFFF))))
    staged = df.withColumn("_v4", F.coalesce(F.when(F.col(ip).rlike(IPV4), F.col(ip)), F.when(mapped.rlike(IPV4), mapped))).withColumn(
        "_text", F.when(F.col("_v4").isNull() & text.contains(":"), F.when(tail == "", text).otherwise(hexed)))
    form = F.col("_text")
    gap = form.contains("::")
    parts = lambda t: F.filter(F.split(t, ":"), lambda p: p != "")
    behind = F.substring(form, F.instr(form, "::") + 2, F.length(form))
    staged = staged.withColumns({
        "_left": parts(F.substring_index(form, "::", 1)), "_right": F.when(gap, parts(behind)).otherwise(F.array().cast("array<string>")),
        "_fine": form.rlike("^[0-9a-f:]+$") & ~form.rlike("^:(?!:)|(?<!:):$|:::|::.*::"), "_gap": gap})
    n = F.size("_left") + F.size("_right")
    fits = F.col("_fine") & F.when(F.col("_gap"), n <= 7).otherwise(n == 8)
    staged = staged.withColumn("_groups", F.when(fits, F.concat("_left", F.array_repeat(F.lit("0"), 8 - n), "_right")))
    whole = F.when(F.forall("_groups", lambda g: F.length(g) <= 4), F.array_join(F.transform("_groups", lambda g: F.lpad(g, 4, "0")), ""))
    staged = staged.withColumn("_hex", whole)
    half = lambda at: F.conv(F.substring(F.col("_hex"), at, 16), 16, -10).cast("long")
    number = _ipv4_number(F.col("_v4"))
    # However it is written, a mapped address is one of IPv4.
    is_mapped = F.col("_hex").startswith("0" * 20 + "ffff")
    return staged.withColumns({
        "_version": F.when(F.col("_v4").isNotNull() | is_mapped, 4).when(F.col("_hex").isNotNull(), 6),
        "_hi": F.when(F.col("_v4").isNotNull() | is_mapped, F.lit(0).cast("long")).otherwise(half(1)),
        "_lo": F.when(F.col("_v4").isNotNull(), number).when(is_mapped, half(17).bitwiseAND(0xFFFFFFFF)).otherwise(half(17)),
    }).drop("_v4", "_text", "_left", "_right", "_fine", "_gap", "_groups", "_hex")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masks(version: int, length: int) -> tuple[int, int]:
    """The two longs that keep the first ``length`` bits of an address."""
    bits = ((1 << 128) - 1) ^ ((1 << ((32 if version == 4 else 128) - length)) - 1)
    return _signed(bits >> 64), _signed(bits & ((1 << 64) - 1))


def _default_blocked() -> Column:
    """The built-in networks as a condition on an address's longs, longest first."""
    nets = [(ipaddress.ip_network(n), flag) for names, flag in (
        (rules.BLOCKED_IPV4, True), (rules.BLOCKED_IPV6, True), (rules.PUBLIC_NETWORKS, False)) for n in names]
    verdict = F
    for net, flag in sorted(nets, key=lambda n: -n[0].prefixlen):
        hi, lo = _masks(net.version, net.prefixlen)
        first = int(net.network_address)
        inside = (F.col("_version") == net.version) & (F.col("_lo").bitwiseAND(F.lit(lo)) == F.lit(_signed(first & ((1 << 64) - 1))))
        if hi and net.version == 6:
            inside = inside & (F.col("_hi").bitwiseAND(F.lit(hi)) == F.lit(_signed(first >> 64)))
        verdict = verdict.when(inside, F.lit(flag))
    return F.coalesce(verdict.otherwise(F.lit(False)), F.lit(False))


def _by_networks(df: DataFrame, networks: DataFrame, out: str) -> DataFrame:
    """``out`` by the longest of ``networks`` (network, blocked) each address lies in; in none it is free.

    Every distinct address meets the networks in one join, with one row for each prefix length that occurs, of which
    there are at most 162.
    """
    cidr = networks.select(
        F.lower(F.split_part("network", F.lit("/"), F.lit(1))).alias("_ip"), F.split_part("network", F.lit("/"), F.lit(2)).try_cast("int").alias("_len"),
        (F.col("blocked") if "blocked" in networks.columns else F.lit(True)).alias("_blocked"))
    known = with_address(cidr, "_ip").withColumn("_len", F.coalesce("_len", F.when(F.col("_version") == 4, 32).otherwise(128)))
    # Written, so that addresses are taken apart once; plans that hold the steps several times are slow to make.
    known = stored(known.filter(F.col("_version").isNotNull() & F.col("_len").between(0, F.when(F.col("_version") == 4, 32).otherwise(128))), "networks")
    lengths = sorted((r["_version"], r["_len"]) for r in known.select("_version", "_len").distinct().collect())

    def cut_to(version: int, length: int) -> list[Column]:
        hi, lo = _masks(version, length)
        return [F.col("_hi").bitwiseAND(F.lit(hi)), F.col("_lo").bitwiseAND(F.lit(lo))]

    def keyed(rows: DataFrame, same: Column) -> DataFrame:
        keys = [F.when((F.col("_version") == v) & same(n), F.struct(F.lit(n).alias("n"), cut_to(v, n)[0].alias("hi"), cut_to(v, n)[1].alias("lo"))) for v, n in lengths]
        entries = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<struct<n:int,hi:bigint,lo:bigint>>")
        return rows.withColumn("_k", F.explode(entries)).withColumns({f"_k{c}": F.col(f"_k.{c}") for c in ("n", "hi", "lo")}).drop("_k")

    on = ["_version", "_kn", "_khi", "_klo"]
    table = keyed(known, lambda n: F.col("_len") == n).groupBy(*on).agg(F.bool_or("_blocked").alias("_blocked"))
    address = ["_version", "_hi", "_lo"]
    asked = stored(df.select(*address).filter("_version IS NOT NULL").distinct(), "asked")
    hits = keyed(asked, lambda n: F.lit(True)).join(table, on).groupBy(*address).agg(F.max_by("_blocked", "_kn").alias("_net"))
    return ordered.lookup(df, stored(hits, "addresses"), address).withColumn(out, F.coalesce("_net", F.lit(False))).drop("_net")


def with_blocked(df: DataFrame, ip: str, out: str, networks: DataFrame | None = None) -> DataFrame:
    """Add ``out``: true for an address that must not be reached, false for other text.

    By default that is all that is not on the public internet; ``networks`` (network, and where given blocked) are the
    caller's own, of any length and both versions, of which the longest that holds an address decides.
    """
    staged = with_address(df, ip)
    judged = staged.withColumn(out, _default_blocked()) if networks is None else _by_networks(staged, networks, out)
    return judged.drop("_hi", "_lo").withColumnRenamed("_version", f"{out}_version")


def _resolved_verdicts(resolved: DataFrame, networks: DataFrame | None) -> DataFrame:
    """One row per host: its first address that must not be reached, if any."""
    judged = with_blocked(resolved.select(F.lower("host").alias("_host"), "ip", F.lower("ip").alias("_ip")), "_ip", "_bad", networks)
    verdicts = judged.groupBy("_host").agg(
        F.min(F.when(F.col("_bad"), F.col("ip"))).alias("_bad_ip"), F.lit(True).alias("_known"))
    return verdicts if networks is None else stored(verdicts, "verdicts")


def guard_urls(df: DataFrame, url: str = "url", resolved: DataFrame | None = None,
               allow_private: bool = False, networks: DataFrame | None = None) -> DataFrame:
    """``is_safe`` and ``reason``; host names are judged by the supplied ``resolved`` (host, ip) table.

    ``networks`` (network as text, and where given blocked) replace the built-in ranges, see :func:`with_blocked`.
    """
    out = with_blocked(df.withColumns({
        "_scheme": F.coalesce(scheme_of(col(url)), F.lit("")), "_host": F.coalesce(host_of(col(url)), F.lit(""))}), "_host", "_inner", networks)
    if resolved is not None and not allow_private:
        out = ordered.lookup(out, _resolved_verdicts(resolved, networks), ["_host"])
    else:
        out = out.withColumn("_bad_ip", F.lit(None).cast("string")).withColumn("_known", F.lit(None).cast("boolean"))
    scheme, host = F.col("_scheme"), F.col("_host")
    reason = (
        F.when(~scheme.isin("http", "https"), F.concat(F.lit("scheme:"), F.coalesce(truthy(scheme), F.lit("none"))))
        .when(host == "", "no_host")
        .when(F.lit(allow_private), "allow_private")
        .when(F.col("_inner"), F.concat(F.lit("ip_blocked:"), host))
        .when(F.col("_inner_version").isNotNull(), "public_ip")
        .when(F.col("_bad_ip").isNotNull(), F.concat(F.lit("resolves_internal:"), host, F.lit("->"), "_bad_ip"))
        .when(F.col("_known"), "public")
        .otherwise("resolve_failed_allow")
    )
    refused = F.regexp_extract(F.col("reason"), r"^(scheme:|no_host|ip_blocked:|resolves_internal:)", 1) != ""
    return out.withColumn("reason", reason).withColumn("is_safe", ~refused).select(*df.columns, "is_safe", "reason")


def absolute_url(base: Column, location: Column) -> Column:
    """``location`` resolved against ``base`` (dot segments removed)."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    no_fragment = F.substring_index(base, "#", 1)
    joined = F.when(location.startswith("/"), location).otherwise(F.concat(folder, location))
    tail = F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)
    kept = F.aggregate(
        F.split(F.regexp_extract(joined, r"^([^?#]*)", 1), "/"),
        F.array().cast("array<string>"),
        lambda done, seg: F.when(seg == ".", done)
        .when(seg == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.array_append(done, seg)),
    )
    ends_in_dots = F.regexp_extract(joined, r"^([^?#]*)", 1).rlike(r"/\.{1,2}$")
    merged = F.concat(F.array_join(kept, "/"), F.when(ends_in_dots, "/").otherwise(""))
    return (
        F.when(location == "", base)
        .when(location.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), location)
        .when(location.startswith("//"), F.concat(scheme_of(base), F.lit(":"), location))
        .when(location.startswith("?"), F.concat(root, path, location))
        .when(location.startswith("#"), F.concat(no_fragment, location))
        .otherwise(F.concat(root, merged, tail))
    )


def resolve_redirects(starts: DataFrame, hops: DataFrame, max_redirects: int = 10, url: str = "url",
                      resolved: DataFrame | None = None, allow_private: bool = False) -> DataFrame:
    """Follow captured hops (url, status, location) from every start.

    Adds ``final_url``, ``hops`` (redirects followed), ``status`` and ``error``.  Redirects are composed to jumps of 2,
    4, 8 ... of them, each in one join of the redirects with themselves, and starts take the jumps that add up to one
    more than ``max_redirects``: 3 rounds for 10 redirects.  A jump ends early at a URL that is no redirect, or one that
    must not be followed; only then is it looked up what that URL is.  Every distinct URL is followed once.
    """
    redirects = [301, 302, 303, 307, 308]
    captured = hops.groupBy(F.col("url").alias("_cur")).agg(F.max(F.struct("status", "location")).alias("_hop"))
    status, location = F.col("_hop.status"), truthy(F.col("_hop.location"))
    moves = status.isin(redirects) & location.isNotNull()
    targets = captured.select(
        "_cur", status.alias("_status"), F.when(moves, absolute_url(F.col("_cur"), location)).alias("_next"))
    table = cut(guard_urls(targets, "_next", resolved, allow_private))

    def onward(moved: DataFrame, jumps: DataFrame) -> DataFrame:
        """``moved`` (_start, _cur, hops) after one more of ``jumps``."""
        named = jumps.select(F.col("_start").alias("_cur"), F.col("_cur").alias("_far"), F.col("hops").alias("_more"))
        return ordered.lookup(moved, named, ["_cur"]).select(
            "_start", F.coalesce("_far", "_cur").alias("_cur"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))

    fetches = max_redirects + 1
    jumps = table.filter(F.col("_next").isNotNull() & F.col("is_safe")).select(
        F.col("_cur").alias("_start"), F.col("_next").alias("_cur"), F.lit(1).alias("hops"))
    moved = starts.select(F.col(url).alias("_start")).filter("_start is not null").distinct().select(
        "_start", F.col("_start").alias("_cur"), F.lit(0).alias("hops"))
    length = 1
    while True:
        if fetches & length:
            moved = onward(moved, jumps)
        length *= 2
        if length > fetches:
            break
        jumps = cut(onward(jumps, jumps))
    ended = ordered.lookup(moved, table, ["_cur"])
    error = (
        F.when(F.col("hops") == fetches, "too_many_redirects")
        .when(F.col("_next").isNotNull(), F.concat(F.lit("ssrf_redirect_blocked:"), "reason"))
        .when(F.col("_status").isNull(), "not_captured")
    )
    results = ended.select(
        F.col("_start").alias(url), F.when(error.isNull(), F.col("_cur")).alias("final_url"), "hops",
        F.when(error.isNull(), F.col("_status")).alias("status"), error.alias("error"))
    return ordered.lookup(starts, cut(results), [url])


def batch_by_host(df: DataFrame, url: str = "url", position: str = "position", n: int | None = None) -> DataFrame:
    """A10: host-grouped layout, input order kept inside a host.

    Range partitioning on (host, position) cuts a hot host into consecutive runs instead of one task.
    Restore input order with ``orderBy(position)``.
    """
    keyed = df.withColumn("host", F.coalesce(truthy(host_of(col(url))), F.lit("unknown")))
    cuts = ["host", position]
    spread = keyed.repartitionByRange(n, *cuts) if n else keyed.repartitionByRange(*cuts)
    return spread.sortWithinPartitions(*cuts)


def _subtag(c: Column) -> Column:
    token = F.substring_index(strip(c), ".", 1)
    token = F.lower(strip(F.regexp_extract(token, r"^([^-_]*)", 1)))
    known = None
    for name, code in rules.LANGUAGE_NAMES.items():
        known = F.when(token == name, code) if known is None else known.when(token == name, code)
    return F.when(token.rlike(r"^[a-z]{2,3}$"), token).otherwise(known)


def normalize_lang(df: DataFrame, cols: str | list[str], fallback: str = "en") -> DataFrame:
    """Primary language subtag; of several columns the first that names a language wins."""
    cols = [cols] if isinstance(cols, str) else cols
    return df.withColumn("lang_code", F.coalesce(*[_subtag(F.col(c)) for c in cols], F.lit(fallback)))
