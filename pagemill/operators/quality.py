"""Response quality (B5-B10).  One ``when`` chain per verdict; only B9 joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules, schema
from ..functions import ordered
from ..functions.text import any_of, col, contains_any, is_json, matching, strip, visible_length
from .pages import visible_text

_SELECTOR = re.compile(r"^(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)?(?:(?P<kind>[#.])(?P<name>[A-Za-z_][\w-]*))?$")


def selector_pattern(selector: str) -> str:
    """Regex over tags for ``tag``, ``#id``, ``.class``, ``tag.class`` and ``tag#id``."""
    m = _SELECTOR.match(selector)
    if not selector or not m:
        raise ValueError(f"unsupported selector: {selector!r}")
    tag = m["tag"] or r"[a-zA-Z][a-zA-Z0-9-]*"
    if not m["kind"]:
        return rf"(?i)<{tag}(?:[\s/][^>]*)?>"
    name = re.escape(m["name"])
    if m["kind"] == "#":
        return rf"<(?i:{tag})\s(?:[^>]*\s)?(?i:id)\s*=\s*(?:\"{name}\"|'{name}'|{name}(?=[\s/>]))"
    one = rf"(?:[^\"'>]*\s)?{name}(?:\s[^\"'>]*)?"
    return rf"<(?i:{tag})\s(?:[^>]*\s)?(?i:class)\s*=\s*(?:\"{one}\"|'{one}'|{name}(?=[\s/>]))"


def selector_hits(html: Column, selectors: list[str]) -> Column:
    return matching([(s, html.rlike(selector_pattern(s))) for s in selectors])


def match_selectors(df: DataFrame, html: str, selectors: list[str]) -> DataFrame:
    """``matched_selectors``; a selector outside the supported subset fails when the plan is built."""
    return df.withColumn("matched_selectors", selector_hits(F.col(html), selectors))


def _header(headers: Column, name: str) -> Column:
    entry = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.lower(F.coalesce(F.get(entry, F.lit(0))["value"], F.lit("")))


def validate_pages(df: DataFrame, status: str = "status", body: str = "body", headers: str | None = "headers",
                   cookies: str | None = "cookies", selectors: list[str] | None = None,
                   bad_sizes: list[int] | None = None) -> DataFrame:
    """``verdict``, ``reasons``, ``matched_selectors``, ``body_size`` (bytes) and ``ok``.

    The layers are tried in order; size is counted in bytes.
    """
    code = F.coalesce(F.col(status), F.lit(0))
    text = F.coalesce(F.col(body), F.lit(""))
    # Columns used by many tests are computed once, in a projection of their own.
    df = df.withColumn("_low", F.lower(text)).withColumn("_size", F.octet_length(text))
    lowered, size = F.col("_low"), F.col("_size")
    reason = lambda *c: F.array(F.concat(*c))
    status_reason = reason(F.lit("status="), code.cast("string"))

    hard = matching([(f"hard:{m}", lowered.contains(m.lower())) for m in rules.HARD_MARKERS])
    soft = matching([(f"soft:{m}", lowered.contains(m)) for m in rules.SOFT_MARKERS])
    any_hard = contains_any(lowered, [m.lower() for m in rules.HARD_MARKERS])
    any_soft = contains_any(lowered, rules.SOFT_MARKERS)

    content_type = _header(F.col(headers), "content-type") if headers else F.lit("")
    looks_json = content_type.contains("json") | text.rlike(r"(?U)^\s*[{\[]")
    json_empty = text.rlike(r'^\s*(?:null|\{\s*\}|\[\s*\]|"")\s*$')
    unresolved = (
        F.coalesce(F.try_element_at(F.col(cookies), F.lit("_abck")).contains("~-1~"), F.lit(False))
        if cookies else F.lit(False)
    )
    complete = contains_any(lowered, ["</html>", "</body>"]) & (visible_length(text) >= rules.VISIBLE_CHARS)

    # (condition, verdict, reasons) in order; the first that holds decides.
    layers = [
        (code == 429, "rate_limited", status_reason),
        (code.isin(401, 407), "auth_required", status_reason),
        (code.isin(404, 410), "not_found", status_reason),
        (code.between(500, 599), "blocked", status_reason),
        (code == 0, "unknown", status_reason),
        (any_hard, "challenge", hard),
    ]
    for bad in bad_sizes or []:
        layers.append((F.abs(size - bad) <= rules.SIZE_TOLERANCE, "challenge",
                       reason(F.lit("size_fp:"), size.cast("string"), F.lit(f"~{bad}"))))
    layers += [
        (looks_json & json_empty, "suspect_ok", reason(F.lit("json_empty"))),
        (looks_json & is_json(text), "weak_ok", reason(F.lit("json_ok"))),
    ]
    hits = selector_hits(text, selectors) if selectors else matching([])
    if selectors:
        some = any_of([text.rlike(selector_pattern(s)) for s in selectors])
        layers += [
            (some & unresolved, "suspect_ok", reason(F.lit("abck_unresolved"))),
            (some, "strong_ok", F.array().cast("array<string>")),
            (F.lit(True), "challenge", reason(F.lit("no_success_selector"))),
        ]
    else:
        small = size < rules.SMALL_BODY_BYTES
        layers += [
            (any_soft, "challenge", soft),
            (small & complete, "weak_ok", reason(F.lit("small_but_complete:"), size.cast("string"))),
            (small, "challenge", reason(F.lit("tiny_body:"), size.cast("string"))),
            (unresolved, "suspect_ok", reason(F.lit("abck_unresolved"))),
            (F.lit(True), "weak_ok", F.array().cast("array<string>")),
        ]
    decided = None
    for i, (cond, _, _) in enumerate(layers):
        decided = F.when(cond, i) if decided is None else decided.when(cond, i)
    # The deciding layer is computed once; verdict and reasons are looked up from its number.
    out = df.withColumn("_layer", decided)
    verdict = F.get(F.array(*[F.lit(v) for _, v, _ in layers]), F.col("_layer"))
    reasons = None
    for i, (_, _, why) in enumerate(layers):
        reasons = F.when(F.col("_layer") == i, why) if reasons is None else reasons.when(F.col("_layer") == i, why)
    selector_layers = [i for i, (_, v, w) in enumerate(layers) if selectors and i >= len(layers) - 3 and v != "challenge"]
    return (
        out.withColumn("verdict", verdict)
        .withColumn("reasons", reasons)
        .withColumn("matched_selectors", F.when(F.col("_layer").isin(selector_layers), hits)
                    .otherwise(F.array().cast("array<string>")) if selector_layers else matching([]))
        .withColumn("body_size", size)
        .withColumn("ok", F.col("verdict").isin(rules.OK_VERDICTS))
        .drop("_layer", "_low", "_size")
    )


def _name_hit(names: Column, pattern: str) -> Column:
    low = pattern.lower()
    if any(c in pattern for c in "*?["):
        glob = "".join(
            ".*" if c == "*" else "." if c == "?" else c if c in "[]" else re.escape(c) for c in low).replace("[!", "[^")
        return F.exists(names, lambda n: n.rlike(f"(?s)^{glob}$"))
    return F.array_contains(names, low)


def detect_waf(responses: DataFrame, signals: dict | None = None, min_confidence: float = 0.0,
               headers: str = "headers", cookies: str = "cookies", body: str = "body") -> DataFrame:
    """Firewall products seen per response, one row per hit with its ``rank`` (block-rate diagnostics).

    Best confidence first, ties in profile order.  The rule list is part of the expression, so responses are
    neither exploded nor shuffled.
    """
    signals = signals or rules.FIREWALL_SIGNALS
    no_names = F.array().cast("array<string>")
    # Each step is a projection of its own, so no value is computed twice.
    seen = responses.withColumns({
        "_cookies": F.transform(F.coalesce(F.map_keys(cookies), no_names), F.lower),
        "_headers": F.transform(F.coalesce(F.map_keys(headers), no_names), F.lower),
        "_server": _header(F.col(headers), "server"),
        "_low": F.lower(F.coalesce(F.col(body), F.lit(""))),
    }).withColumns({
        f"_found{i}": matching(
            [(f"cookie:{p}", _name_hit(F.col("_cookies"), p)) for p in spec.get("cookie", [])]
            + [(f"header:{p}", _name_hit(F.col("_headers"), p)) for p in spec.get("header", [])]
            + [(f"server:{p}", F.col("_server").contains(p.lower())) for p in spec.get("server", [])]
            + [(f"body:{p}", F.col("_low").contains(p.lower())) for p in spec.get("body", [])])
        for i, spec in enumerate(signals.values())
    })
    scored = []
    for i, (profile, spec) in enumerate(signals.items()):
        found = F.col(f"_found{i}")
        confidence = (
            F.when(F.size(found) >= spec.get("strong", rules.STRONG_SIGNALS), 0.9)
            .when(F.size(found) >= spec.get("weak", rules.WEAK_SIGNALS), 0.6).otherwise(0.3))
        scored.append(F.struct(
            (-confidence).alias("order"), F.lit(i).alias("no"), F.lit(profile).alias("profile"),
            confidence.alias("confidence"), found.alias("signals")))
    fallback = F.array(F.struct(
        F.lit(-0.1).alias("order"), F.lit(0).alias("no"), F.lit("unknown_challenge").alias("profile"),
        F.lit(0.1).alias("confidence"), F.array(F.lit("fallback")).alias("signals")))
    hits = F.array_sort(F.filter(
        F.array(*scored), lambda h: (F.size(h["signals"]) > 0) & (h["confidence"] >= min_confidence)))
    return (
        seen.withColumn("_hits", hits)
        .withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(fallback))
        # The outer form: for an inner one Spark would test the array's size below, computing it a second time.
        .select(*responses.columns, F.posexplode_outer("_hits").alias("_i", "_hit"))
        .select(*responses.columns, (F.col("_i") + 1).alias("rank"), "_hit.profile", "_hit.confidence", "_hit.signals")
    )


def looks_like_shell(text: Column, verdict: Column, html: Column) -> Column:
    return (
        (F.length(strip(text)) < rules.SHELL_CHARS)
        | (verdict == "weak_ok")
        | F.coalesce(html, F.lit("")).rlike(rules.SHELL_MARKERS)
    )


def detect_shell(df: DataFrame, text: str = "text", verdict: str = "verdict", html: str = "html") -> DataFrame:
    """``shell_suspected``: the page probably needs a browser to show its text."""
    return df.withColumn("shell_suspected", looks_like_shell(F.col(text), F.col(verdict), F.col(html)))


def merge_renderings(static: DataFrame, rendered: DataFrame | None, mode: str = "auto") -> DataFrame:
    """Static and rendered capture of one URL become one row with an honest ``content_label``.

    ``static``: url, html, verdict, ok, optional error (an ``ssrf…`` text blocks).  ``rendered``: url, html,
    optional error.  ``mode``: auto (only shells), always, never.
    """
    base = static if "error" in static.columns else static.withColumn("error", F.lit(None).cast("string"))
    base = base.withColumn("static_text", visible_text("html")).withColumn(
        "shell_suspected", looks_like_shell(F.col("static_text"), F.col("verdict"), F.col("html")))
    ssrf = r"^(?:ssrf_blocked:|ssrf_redirect_blocked:)"
    blocked = F.coalesce(F.col("error").rlike(ssrf), F.lit(False))
    wanted = {
        "auto": F.col("ok") & F.col("shell_suspected"), "always": F.lit(True), "never": F.lit(False),
    }[mode] & ~blocked
    base = base.withColumn("_wanted", wanted)
    if rendered is None:
        joined = base.withColumn("_text", F.lit(None).cast("string")).withColumn(
            "_render_error", F.lit(None).cast("string"))
    else:
        shots = rendered if "error" in rendered.columns else rendered.withColumn(
            "error", F.lit(None).cast("string"))
        # Only renderings that some capture asks for are read; the static page stays out of the join.
        asked = base.filter("_wanted").select("url").distinct()
        shots = shots.join(asked, "url", "left_semi").select(
            "url", visible_text("html").alias("_text"), F.col("error").alias("_render_error"))
        joined = ordered.lookup(base, shots, ["url"])
        joined = joined.withColumns({c: F.when(F.col("_wanted"), F.col(c)) for c in ("_text", "_render_error")})
    late_block = F.coalesce(F.col("_render_error").rlike(ssrf), F.lit(False))
    ssrf_hit = blocked | late_block
    better = F.coalesce(
        F.col("_render_error").isNull()
        & (F.length(strip(F.col("_text"))) > F.length(strip(F.col("static_text")))), F.lit(False)) & F.col("_wanted")
    chosen = better & ~ssrf_hit
    label = (
        F.when(ssrf_hit, "ssrf_blocked").when(better, "js_rendered").when(~F.col("ok"), "failed")
        .when(F.col("shell_suspected"), "ssr_shell_only").otherwise("ok")
    )
    return (
        joined.withColumn("content_label", label)
        .withColumn("body_text", F.when(ssrf_hit, "").when(better, F.col("_text")).otherwise(F.col("static_text")))
        .withColumn("tier", F.when(chosen, 2).otherwise(1))
        .withColumn("engine_ok", F.col("ok") & ~ssrf_hit)
        .withColumn("js_error", F.when(blocked, F.col("error")).otherwise(F.col("_render_error")))
        .drop("_wanted", "_text", "_render_error", "static_text")
    )


def normalize_web(df: DataFrame, url: str = "url", final_url: str | None = None,
                  fetched_at: Column | None = None) -> DataFrame:
    """Merged renderings to the normalized record."""
    canonical = strip(url)
    final = F.coalesce(F.nullif(F.col(final_url), F.lit("")), canonical) if final_url else canonical
    details = schema.meta(
        fetched_at=F.lit(None) if fetched_at is None else fetched_at,
        extra={
            "tier": F.col("tier"), "verdict": F.col("verdict"), "final_url": final,
            "content_label": F.col("content_label"), "engine_ok": F.col("engine_ok"), "js_error": F.col("js_error"),
        },
    )
    return schema.record(df, F.col(url), "web", F.col("body_text"), details)
