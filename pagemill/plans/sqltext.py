"""Small text builders for the checking SQL."""

from __future__ import annotations

from ..functions.text import WHITESPACE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def unescape(x: str) -> str:
    """The entities that occur in the driver pages; the ampersand comes last."""
    for name, char in [("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
                       ("&nbsp;", "\xa0"), ("&#39;", "'"), ("&amp;", "&")]:
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return x


_SKIP = "|".join(rf"<{t}(?:[\s/][^>]*)?>.*?</{t}(?:[\s/][^>]*)?>" for t in ("script", "style", "noscript", "template"))
MARKUP = rf"<!--.*?-->|{_SKIP}|<[!?][^>]*>|</?[a-z](?:[^'"">]|""[^""]*""|'[^']*')*>".replace('""', '"')


def visible_text(html: str) -> str:
    chunks = f"string_split(regexp_replace({html}, {lit(MARKUP)}, chr(1), 'gis'), chr(1))"
    return (
        f"array_to_string(list_filter(list_transform({chunks}, lambda c: {strip(unescape('c'))}), lambda c: c <> ''), chr(10))"
    )


def host(u: str) -> str:
    return (
        f"lower(CASE WHEN regexp_extract({u}, '//([^/?#]*)', 1) LIKE '%[%' "
        f"THEN regexp_extract({u}, '//[^/?#]*\\[([^\\]]*)\\]', 1) "
        f"ELSE regexp_extract({u}, '//(?:[^/?#@]*@)?([^/?#:]*)', 1) END)"
    )


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
