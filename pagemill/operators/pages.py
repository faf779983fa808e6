"""Page text and metadata (B1-B4, B14, B15): narrow projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import CHUNK, col, join_lines, strip, truthy, unescape, url_base, whole_json
from ..functions.text import unescape as decode_references

# Comments, scripts and styles with what they hold, declarations and tags; leftmost wins, so a tag inside a comment stays
# hidden.  The common "<" comes first: other characters cost one comparison.
_RAW = r"""(script|style)(?=[\s/>])[^>]*+(?<![\s"']/)(?<!script/|style/)>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"""
_TAG = r"""/?[a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|/?[a-z][^>]*+>"""
MARKUP = rf"(?is)<(?:!--.*?-->|{_RAW}|[!?][^>]*+>|{_TAG})"
# Noscript and template are parsed like any element, and may hold themselves; they hide what they hold.  Whatever ends one
# of the four hidden elements takes one level away.
_HIDING = r"""(noscript|template)(?=[\s/>])(?:[^'">]++|"[^"]*+"|'[^']*+')*+(?<![\s"']/)(?<!noscript/|template/)>"""
LEVELS = rf"(?is)<(?:!--.*?-->|{_RAW}|[!?][^>]*+>|{_HIDING}|(/)(?:script|style|noscript|template)(?=[\s/>])[^>]*+>|{_TAG})"


_OPEN = "\u0002"  # stands for a "<" that opens no tag
_LEVEL, _DOWN, _UP = "\u0003", "\u0004", "\u0005"  # a tag, one that hides what follows, one that ends that
# Rounds in which innermost hidden elements are taken out, before deeper ones are walked through.
_ROUNDS = 64


def _after_last(text: Column, closer: str, opener: str, instead: str) -> Column:
    """Exchange the openers behind the last closer."""
    tail = F.substring_index(text, closer, -1)
    head = F.left(text, F.length(text) - F.length(tail))
    return F.when(tail.contains(opener), F.concat(head, F.replace(tail, F.lit(opener), F.lit(instead)))).otherwise(text)


def _without_hidden(source: Column) -> Column:
    """The text of a page with noscript or template elements, a mark for each tag, without what is hidden.

    Levels are counted as brackets: in each round the innermost pairs go, all at once; what then still opens hides the
    rest of the page, and what still closes had nothing to close.  Pages nested deeper than the rounds go are walked
    through, piece by piece.
    """
    marked = F.regexp_replace(source, LEVELS, f"{CHUNK}{_LEVEL}$2$3{CHUNK}")
    marked = F.regexp_replace(marked, f"(?i){_LEVEL}(?:noscript|template){CHUNK}", _DOWN)
    marked = F.replace(F.replace(marked, F.lit(f"{_LEVEL}/{CHUNK}"), F.lit(_UP)), F.lit(_LEVEL), F.lit(""))
    opened = F.length(marked) - F.length(F.replace(marked, F.lit(_DOWN), F.lit("")))
    rounds = F.sequence(F.lit(0), F.least(F.lit(_ROUNDS), opened))
    flat = F.aggregate(rounds, marked, lambda text, _: F.regexp_replace(text, f"{_DOWN}[^{_DOWN}{_UP}]*+{_UP}", CHUNK))

    def step(state: Column, piece: Column) -> Column:
        """``piece`` begins with the mark that comes before it."""
        depth = F.greatest(F.lit(0), state["depth"] + F.when(piece.startswith(_DOWN), 1).when(piece.startswith(_UP), -1).otherwise(0))
        return F.struct(F.when(depth == 0, F.concat(state["text"], F.lit(CHUNK), piece)).otherwise(state["text"]).alias("text"), depth.alias("depth"))

    def walked(text: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"))
        return F.aggregate(F.split(text, f"(?=[{_DOWN}{_UP}])"), start, step, lambda state: state["text"])

    def visible(text: Column) -> Column:
        return F.when(text.rlike(f"(?s){_DOWN}.*{_UP}"), walked(text)).otherwise(F.substring_index(text, _DOWN, 1))

    # A lambda binds the text, which is then looked at several times.
    return F.translate(F.transform(F.array(flat), visible)[0], f"{_DOWN}{_UP}", f"{CHUNK}{CHUNK}")


def visible_text(html: Column | str) -> Column:
    """B1 as an expression: text chunks between tags, hidden elements dropped, one chunk per line."""
    source = F.replace(F.coalesce(col(html), F.lit("")), F.lit(CHUNK), F.lit(" "))
    # Comments and tags that nothing closes would each search to the end of the page.
    source = _after_last(source, "-->", "<!--", "<!- -")
    source = _after_last(source, ">", "<", f"{CHUNK}{_OPEN}{CHUNK}")
    nested = source.rlike(r"(?i)<(?:noscript|template)[\s/>]")
    unmarked = F.translate(source, f"{_LEVEL}{_DOWN}{_UP}", "   ")
    bare = F.when(nested, _without_hidden(unmarked)).otherwise(F.regexp_replace(source, MARKUP, CHUNK))
    # What is left of "<" opens no tag; it is a chunk of its own.
    chunks = F.split(F.replace(F.replace(bare, F.lit(_OPEN), F.lit("<")), F.lit("<"), F.lit(f"{CHUNK}<{CHUNK}")), CHUNK)
    return join_lines(F.filter(F.transform(chunks, lambda c: strip(unescape(c))), lambda c: c != ""))


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """B1: visible text of a page; null html gives ''."""
    return pages.withColumn(out, visible_text(html))


def og_content(html: Column, prop: str) -> Column:
    """Content of the first ``<meta>`` whose property is ``prop``, attribute order irrelevant."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    wanted = F.filter(
        tags,
        lambda t: (F.lower(F.regexp_extract(t, r'(?i)property="([^"]*)"', 1)) == prop)
        & t.rlike(r'(?i)content="[^"]*"'),
    )
    return strip(unescape(F.regexp_extract(F.get(wanted, F.lit(0)), r'(?i)content="([^"]*)"', 1)))


def extract_og(pages: DataFrame, props: list[str], html: str = "html") -> DataFrame:
    """B2: one column per property, named after it with ``:`` as ``_``."""
    return pages.withColumns({p.replace(":", "_"): og_content(F.col(html), p) for p in props})


def _up_to_last(html: Column, closer: str) -> Column:
    """The page up to its last closer: an opener behind it would search to the end of the page, each one anew."""
    return F.regexp_extract(html, f"(?is)^(.*{closer})", 1)


def _clean(fragment: Column) -> Column:
    text = unescape(F.regexp_replace(fragment, r"<[^>]+>", " "))
    text = F.translate(text, "\xa0​", " ")
    return strip(F.regexp_replace(text, r"[ \t\f\x0B]+", " "))


def paragraphs_text(html: Column, para_class: str | None) -> Column:
    wanted = "" if para_class is None else rf'[^>]+class="[^"]*{para_class}[^"]*"'
    pattern = rf"(?is)<p{wanted}[^>]*>(.*?)</p>" if para_class else r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
    bodies = F.transform(F.regexp_extract_all(_up_to_last(html, "</p>"), F.lit(pattern), F.lit(1)), _clean)
    kept = F.filter(bodies, lambda b: b != "")
    text = strip(F.regexp_replace(join_lines(kept), r"\n{3,}", "\n\n"))
    return F.when(F.size(kept) > 0, text).otherwise(F.coalesce(og_content(html, "og:description"), F.lit("")))


def extract_paragraphs(pages: DataFrame, para_class: str | None = "se-text-paragraph", html: str = "html",
                       out: str = "body_text") -> DataFrame:
    """Paragraph text (``para_class=None`` takes every paragraph), else the page description."""
    return pages.withColumn(out, paragraphs_text(F.col(html), para_class))


def first_by_base(df: DataFrame, urls: str, out: str) -> DataFrame:
    """``out``: of the URLs in array ``urls`` that are equal up to ``?`` the first, in order.

    Sorted by base, a URL is the first of its base where the one before has another base.  Each step is a column of
    its own, as a lambda would compute what it refers to again for every element.
    """
    pairs = F.transform(F.coalesce(F.col(urls), F.array().cast("array<string>")), lambda u, i: F.struct(
        url_base(u).alias("base"), i.alias("pos"), u.alias("url")))
    staged = df.withColumn("_by_base", F.array_sort(pairs))
    staged = staged.withColumn("_first", F.filter(
        "_by_base", lambda e, i: (i == 0) | ~F.get("_by_base", i - 1)["base"].eqNullSafe(e["base"])))
    staged = staged.withColumn("_first", F.array_sort(F.transform("_first", lambda e: F.struct(e["pos"], e["url"]))))
    return staged.withColumn(out, F.transform("_first", lambda e: e["url"])).drop("_by_base", "_first")


def extract_media_urls(pages: DataFrame, pattern: str = rules.BLOG_IMAGE, allow_hosts: str = rules.BLOG_IMAGE_HOST,
                       unescape: bool = False, html: str = "html", out: str = "media_urls") -> DataFrame:
    """Media URLs of a page, in page order; of URLs equal up to ``?`` the first stays.

    Videos decode references before the host test, images do not.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
    if unescape:
        found = F.transform(found, decode_references)
    allowed = pages.withColumn("_found", found).withColumn("_allowed", F.filter("_found", lambda u: u.rlike(allow_hosts)))
    return first_by_base(allowed, "_allowed", out).drop("_found", "_allowed")


def extract_embedded_json(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per script whose text from the first ``{`` to the last ``}`` parses; ``payload`` is VARIANT."""
    scripts = F.regexp_extract_all(
        _up_to_last(F.col(html), r"</script\s*>"), F.lit(r"(?is)<script(?=[\s/>])[^>]*>(.*?)</script\s*>"), F.lit(1))
    braces = F.transform(scripts, lambda s: truthy(F.regexp_extract(s, r"(?s)\{.*\}", 0)))
    return (
        pages.select(*[c for c in pages.columns if c != html], F.posexplode_outer(braces).alias("script_no", "json_text"))
        .withColumn("payload", F.try_parse_json(whole_json("json_text")))
        .filter(F.col("payload").isNotNull())
    )


def strip_json_guard(df: DataFrame, body: str = "body") -> DataFrame:
    """Remove the leading ``for (;;);`` some endpoints put before their JSON."""
    return df.withColumn(body, F.regexp_replace(F.col(body), r"^for \(;;\);", ""))
