"""Objects under a key of a JSON text, at any depth, as slices of the text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

# Strings (with the colon that makes them keys), brackets and commas; nothing else matters to where things are.
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*+)"(\s*:)?|([{\[])|([}\]])|,', re.DOTALL)


def objects_under(text: str, wanted: str, blocked: Iterable[str], max_depth: int | None = None) -> tuple[list[tuple[tuple[int, ...], str]], bool]:
    """(path, text) of every object under the key ``wanted`` outside ``blocked`` keys, and whether deeper ones were left out.

    ``text`` is valid JSON.  A path holds positions from the top, in the order of the text, so enclosing objects come
    before what they hold.  Of a key that comes twice in one object the last value counts, at the place of the first.
    """
    blocked, found, deeper = set(blocked), {}, False
    # Of each open container: key positions (None for an array), where it began, and whether it is wanted.
    opened: list[tuple[dict[str, int] | None, int, bool]] = []
    path: list[int] = []
    key, skipped, kept_from = None, 0, None
    for token in _TOKEN.finditer(text):
        word, colon, begins, ends = token.groups()
        if skipped:
            # Inside a subtree that is passed over, brackets alone count.
            skipped += 1 if begins else -1 if ends else 0
            if not skipped and kept_from is not None:
                found[tuple(path)], kept_from = (kept_from, token.end()), None
        elif begins:
            named = begins == "{" and key == wanted
            if key in blocked:
                skipped = 1
            elif max_depth is not None and len(path) >= max_depth:
                skipped, deeper = 1, True
                kept_from = token.start() if named and len(path) == max_depth else None
            else:
                opened.append(({} if begins == "{" else None, token.start(), named))
                path.append(0)
            key = None
        elif ends:
            _, start, named = opened.pop()
            path.pop()
            if named:
                found[tuple(path)] = (start, token.end())
        elif word is not None:
            if colon and opened and opened[-1][0] is not None:
                key = json.loads(f'"{word}"') if "\\" in word else word
                places = opened[-1][0]
                if key in places:
                    path[-1] = places[key]
                    held = tuple(path)
                    found = {p: v for p, v in found.items() if p[: len(held)] != held}
                else:
                    path[-1] = places[key] = len(places)
        elif opened and opened[-1][0] is None:
            path[-1] += 1
            key = None
        else:
            key = None
    return [(p, text[a:b]) for p, (a, b) in sorted(found.items())], deeper
