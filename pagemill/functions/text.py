"""Text and URL column expressions (JVM-side only)."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)

CHUNK = "\u0001"  # stands for "a tag was here" while markup is being removed

_KV, _PAIR = "\u0002", "\u0003"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Both-sided strip of all Unicode white space (``trim`` alone removes spaces only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def truthy(c: Column | str) -> Column:
    """The string, or null when it is empty."""
    return F.nullif(col(c), F.lit(""))


def url_base(c: Column | str) -> Column:
    """The part of a URL before the first ``?``."""
    return F.substring_index(col(c), "?", 1)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, needles: list[str]) -> Column:
    return any_of([c.contains(n) for n in needles])


def matching(pairs: list[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Lower-cased host without user info and port; IPv6 literals lose their brackets."""
    netloc = F.regexp_replace(netloc_of(url), r"^.*@", "")
    bracketed = F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)
    plain = F.substring_index(netloc, ":", 1)
    return F.lower(F.when(netloc.startswith("["), bracketed).otherwise(plain))


def port_of(url: Column) -> Column:
    return F.regexp_extract(netloc_of(url), r":(\d+)$", 1)


def with_netloc(url: Column, netloc: Column) -> Column:
    """``url`` with its host part exchanged."""
    head = F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)", 1)
    tail = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(?s)(.*)$", 1)
    return F.concat(head, netloc, tail)


def suffix_of(path: Column) -> Column:
    """Lower-cased file extension with its dot, '' when there is none."""
    name = F.substring_index(F.regexp_replace(path, r"/+$", ""), "/", -1)
    return F.lower(F.regexp_extract(name, r"(?s)^[^/]+(\.[^./]+)$", 1))


def _codepoint(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _literal_map(pairs: dict[str, str]) -> Column:
    text = _PAIR.join(f"{k}{_KV}{v}" for k, v in pairs.items())
    return F.str_to_map(F.lit(text), F.lit(_PAIR), F.lit(_KV))


# The entity names come from the standard library's own table.
_NAMED = {k: v for k, v in html5.items() if k.endswith(";")}
_UNTERMINATED = {k: v for k, v in html5.items() if not k.endswith(";")}
# Numeric references 128..159 mean the Windows code page.
_C1 = {str(i): bytes([i]).decode("cp1252", "replace") for i in range(128, 160)}


def _reference(piece: Column) -> Column:
    """What ``&`` + piece stands for; ``piece`` is the text up to the next ``&``."""
    number = F.coalesce(
        truthy(F.regexp_extract(piece, r"^#([0-9]{1,9});?", 1)).cast("long"),
        F.conv(truthy(F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,8});?", 1)), 16, 10).cast("long"),
    )
    after_number = F.regexp_replace(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
    undefined = (
        number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
        | number.between(64976, 65007) | (F.pmod(number, F.lit(65536)) >= 65534)
    )
    character = (
        F.when((number == 0) | number.between(55296, 57343) | (number > 1114111), F.lit("�"))
        .when(number.between(128, 159), F.element_at(_literal_map(_C1), number.cast("string")))
        .when(undefined, F.lit(""))
        .otherwise(_codepoint(number))
    )
    name = F.regexp_extract(piece, r"^([^\t\n\f <&#;]{1,31};)", 1)
    # The map is searched from its start, so the few names that make up most references come before it.
    named = F.when(name == "", F.lit(None))
    for common in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;"):
        named = named.when(name == common, _NAMED[common])
    named = named.otherwise(F.try_element_at(_literal_map(_NAMED), name))
    longest_first = "|".join(sorted(_UNTERMINATED, key=len, reverse=True))
    short = F.regexp_extract(piece, f"^({longest_first})", 1)
    unterminated = F.try_element_at(_literal_map(_UNTERMINATED), short)
    return (
        F.when(number.isNotNull(), F.concat(character, after_number))
        .when(named.isNotNull(), F.concat(named, F.substr(piece, F.length(name) + 1)))
        .when(unterminated.isNotNull(), F.concat(unterminated, F.substr(piece, F.length(short) + 1)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(c: Column | str) -> Column:
    """Decode named and numeric character references, each exactly once."""
    c = col(c)
    pieces = F.split(c, "&")
    decoded = F.transform(F.slice(pieces, 2, F.size(pieces)), _reference)
    return F.when(c.contains("&"), F.concat(pieces[0], F.array_join(decoded, ""))).otherwise(c)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def visible_length(html: Column) -> Column:
    """Characters left once scripts, styles and tags are gone and white space is folded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    return F.length(F.btrim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def is_json(text: Column | str) -> Column:
    """True when the whole text is one JSON value.

    Spark's readers stop after the first value, so the text is set between two keys: anything behind its value
    spoils the object.  Repeated keys inside are fine.
    """
    keys = F.json_object_keys(F.concat(F.lit('{"v":'), col(text), F.lit(',"end":0}')))
    return F.coalesce(keys == F.array(F.lit("v"), F.lit("end")), F.lit(False))


def whole_json(text: Column | str) -> Column:
    """The text where it is JSON as a whole, else null."""
    return F.when(is_json(text), col(text))
