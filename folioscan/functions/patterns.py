"""Regular expressions that are built on the driver from user queries."""

from __future__ import annotations

import re

from folioscan.functions import dialect

# Classes of characters that stand for one another, the traditional form first.
VARIANT_CLASSES = ["經経经", "觀観观", "佛仏", "譯訳译", "藏蔵", "禪禅", "淨浄净", "證証证", "覺覚觉", "聖圣", "會会", "後后", "國国", "靈灵", "廣广", "龍龙", "臺台", "體体", "彌弥", "俱倶", "舍舎"]

_CLASS_OF = {c: group for group in VARIANT_CLASSES for c in group}
_SPECIAL = set(".+*?[](){}|\\")

def looks_like_regex(query: str) -> bool:
    return any(c in _SPECIAL for c in query)


def escape(literal: str) -> str:
    return re.sub(r"([\\.+*?()\[\]{}|^$#&\-~])", r"\\\1", literal)


def _fuzzy(literal: str, variants: bool) -> str:
    parts = re.split(r"(\s+)", literal)
    out = []
    for part in parts:
        if part and part.isspace():
            out.append(r"\s*")
        else:
            out.extend(f"[{_CLASS_OF[c]}]" if variants and c in _CLASS_OF else escape(c) for c in part)
    return "".join(out)


def whitespace_fuzzy(literal: str) -> str:
    """White space in the literal matches any amount of it."""
    return _fuzzy(literal, variants=False)


def variant_fuzzy(literal: str) -> str:
    """As whitespace_fuzzy, and characters match all of their class."""
    return _fuzzy(literal, variants=True)


def compile_query(query: str, is_regex: bool = False, need_space: bool = True, variants: bool = False) -> str:
    """The pattern of a query: itself if it is one, else a fuzzy literal (only with white space in it, if need_space)."""
    if is_regex or looks_like_regex(query) or (need_space and not re.search(r"\s", query)):
        return query
    return variant_fuzzy(query) if variants else whitespace_fuzzy(query)


def java_pattern(pattern: str, ignore_case: bool = True) -> str | None:
    """The pattern for Spark, with Unicode classes; None where it is invalid or not of the linear-time dialect.

    Flags: only a line feed ends a line. Without the flag m, ^ and $ are the text's ends.
    """
    try:
        out = dialect.translated(pattern)
    except dialect.Invalid:
        return None
    return ("(?iUd)" if ignore_case else "(?Ud)") + out
