"""Tools by name: what a front end calls, with its arguments checked here."""

from __future__ import annotations

#: Unified tools and what they stand for in each source; direct, title and resolve don't depend on the source.
SOURCES = ("cbeta", "tipitaka", "gretil", "sarit", "muktabodha", "sat", "jozen", "tibetan")
KINDS = ("search", "fetch", "title_search", "pipeline")


class Invalid(ValueError):
    """An unknown tool, a missing or an unknown source."""


def dispatch(tool: str, args: dict) -> tuple[str, dict]:
    """A unified tool and its arguments to the source's own tool and arguments."""
    if tool == "resolve":
        return "resolve", dict(args)
    if tool not in KINDS:
        raise Invalid(f"no such tool: {tool}")
    source = args.get("source")
    if source is None and tool == "fetch" and args.get("id"):
        source = source_of(str(args["id"]))
    if source not in SOURCES:
        raise Invalid(f"source must be one of {', '.join(SOURCES)}")
    return f"{source}_{tool}", {k: v for k, v in args.items() if k != "source"}


def source_of(identifier: str) -> str | None:
    """functions.text.detect_source() for one identifier on the driver."""
    import re

    i = identifier.strip()
    up = i.upper()
    rules = [("cbeta", re.match("T[0-9]", up)), ("tipitaka", re.match("(DN|MN|SN|AN|KN)[0-9]", up)), ("tipitaka", ".mul" in i), ("jozen", re.match("J[0-9]{2}_", up)), ("gretil", i.startswith("sa_")), ("sat", "," in i and re.fullmatch("[0-9,]+", i))]
    return next((name for name, hit in rules if hit), None)


def unified(tool: str, args: dict) -> tuple[str, dict]:
    """The way back, for suggestions that name a source's own tool."""
    for source in SOURCES:
        for kind in KINDS:
            if tool == f"{source}_{kind}":
                return kind, {"source": source, **args}
    return tool, dict(args)


def rewritten(meta: dict) -> dict:
    """An answer's meta with every tool that it names as a unified one: suggestions, the hint, what fetches candidates and the pick."""

    def tool(ref):
        if not isinstance(ref, dict) or not isinstance(ref.get("tool"), str):
            return ref
        name, args = unified(ref["tool"], ref.get("args") or {})
        return ref if name == ref["tool"] else {**ref, "tool": name, "args": args}

    def fetching(item):
        return {**item, "fetch": tool(item["fetch"])} if isinstance(item, dict) and "fetch" in item else item

    each = {
        "fetchSuggestions": lambda v: [tool(x) for x in v], "pipelineHint": tool,
        "candidates": lambda v: [fetching(x) for x in v], "pick": fetching,
    }
    return {k: each[k](v) if k in each and v is not None else v for k, v in meta.items()}


def exit_code(message: str) -> int:
    """10: not found, 11: network, 12: data, else 1."""
    low = message.lower()
    for code, words in ((10, ("not found", "no such", "no match")), (11, ("network", "timeout", "timed out", "connection")), (12, ("parse", "decode", "invalid data"))):
        if any(w in low for w in words):
            return code
    return 1
