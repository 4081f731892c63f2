"""Passages of one document: slices, lines, anchors, sections and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import markup
from folioscan.functions import text as T
from folioscan.functions.patterns import escape, java_pattern, variant_fuzzy
from folioscan.operators import grams, rank
from folioscan.sources import hits

#: Characters of a slice without an end, and of a fetched text.
SLICE, FETCHED = 8_000, 6_000


def slice_bounds(total: Column, page: int | None = None, page_size: int | None = None, start: int | None = None, end: int | None = None, most: int | None = None) -> tuple[Column, Column]:
    """(start, end) in characters: a page goes first, then an end, then a length, else SLICE characters; clamped."""
    if page is not None and page_size is not None:
        lo, hi = page * page_size, page * page_size + page_size
    else:
        lo = start or 0
        hi = end if end is not None else lo + most if most is not None else lo + SLICE
    first = F.least(F.lit(lo), total)
    return first, F.greatest(first, F.least(F.lit(hi), total))


def char_slice(text: Column, **args) -> Column:
    """struct<slice, total, start, end>; see slice_bounds()."""
    lo, hi = slice_bounds(F.length(text), **args)
    return F.struct(F.substring(text, lo + 1, hi - lo).alias("slice"), F.length(text).alias("total"), lo.alias("start"), hi.alias("end"))


def context_lines(text: Column, line: Column, before: int, after: int) -> Column:
    def around(rows: Column) -> Column:
        ok = (line >= 1) & (line <= F.size(rows))
        lo = F.when(ok, F.greatest(line - before, F.lit(1))).otherwise(F.lit(1))
        n = F.when(ok, F.least(line + after, F.size(rows)) - lo + 1).otherwise(F.lit(0))
        return F.array_join(F.slice(rows, lo, n), "\n")

    return T.let(T.lines(text), around)


def context_text(xml: Column, line: Column, before: int, after: int) -> Column:
    """context_lines() without markup, white space collapsed."""
    plain = F.pandas_udf(lambda s: s.map(markup.extract_text), "string")
    return plain(context_lines(xml, line, before, after))


def part_argument(value) -> str | None:
    """The part that a request names: a text that isn't blank, or a whole number from 0."""
    if isinstance(value, str):
        return value.strip() or None
    return str(value) if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else None


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that the 1-based character offset is in."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset - 1), "[^\n]", "")) + 1


def marker_context(xml: Column, marker: str, before: int, after: int) -> Column:
    """Lines around the line-break marker n=marker, however it is quoted, else the whole text without markup."""
    at = F.regexp_instr(xml, F.lit(rf"""<lb\b[^>]*\bn\s*=\s*["']{escape(marker)}["']"""))
    plain = F.pandas_udf(lambda s: s.map(markup.extract_text), "string")
    return F.when(at > 0, context_lines(xml, line_of(xml, at), before, after)).otherwise(plain(F.when(at == 0, xml)))


def marker_near(line: Column, anchor: Column) -> Column:
    """The last marker that begins at or before the anchor, else the first of the line; null without markers."""
    pattern = F.lit(r"""<lb\b[^>]*\bn\s*=\s*["']([^"']+)["']""")
    anchor = F.regexp_replace(anchor, r"(?U)^\s+|\s+\z", "")
    at = F.instr(line, anchor)
    upto = F.when((at > 0) & (anchor != ""), F.substring(line, F.lit(1), at - 1)).otherwise(F.lit(""))
    before = F.regexp_extract_all(upto, pattern, F.lit(1))
    every = F.regexp_extract_all(line, pattern, F.lit(1))
    return F.when(F.size(before) > 0, F.element_at(before, -1)).when(F.size(every) > 0, F.element_at(every, 1))


_HEAD = r"(?is)<head\b[^>]*>(.*?)</head>"


def heads(xml: Column) -> Column:
    """The inner texts of flat head elements, without markup."""
    return F.transform(F.regexp_extract_all(xml, F.lit(_HEAD), F.lit(1)), lambda h: T.collapse_spaces(F.regexp_replace(h, "<[^>]+>", "")))


def sections(xml: Column) -> Column:
    """array<struct<head, body>>: each head's raw inner text, and what follows it up to the next head."""
    inner = F.regexp_extract_all(xml, F.lit(_HEAD), F.lit(1))
    bodies = F.split(xml, r"(?is)<head\b[^>]*>.*?</head>", -1)
    return F.transform(inner, lambda h, i: F.struct(h.alias("head"), F.get(bodies, i + 1).alias("body")))


def section_by_head(xml: Column, query: str | None = None, index: int | None = None) -> Column:
    """The first section whose raw head holds query, in any case, or that at the 0-based index; null if none."""
    every = sections(xml)
    if query is not None:
        every = F.filter(every, lambda s: F.contains(F.lower(s["head"]), F.lit(query.lower())))
        index = 0
    return F.get(every, F.lit(index))["body"]


def highlight(text: Column, pattern: str, prefix: str = ">>> ", suffix: str = " <<<", is_regex: bool = True) -> Column:
    p = java_pattern(pattern if is_regex else escape(pattern), ignore_case=is_regex)
    if p is None or not pattern:
        return text
    safe = [s.replace("\\", "\\\\").replace("$", "\\$") for s in (prefix, suffix)]
    return F.regexp_replace(text, f"({p})", f"{safe[0]}$1{safe[1]}")


def highlight_count(text: Column, pattern: str, is_regex: bool = True) -> Column:
    p = java_pattern(pattern if is_regex else escape(pattern), ignore_case=is_regex)
    return F.lit(0) if p is None or not pattern else F.regexp_count(text, F.lit(p))


#: Lengths that are summed up in a row.
RUN = 256
#: Signs that stand for no character; they enclose matches.
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufdd2"


def running_sums(lengths: Column) -> Column:
    """The sum of what is before each element. Sums of RUN elements are summed first, as an array grows by being copied."""
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")
    sums = lambda xs, first: F.aggregate(xs, F.struct(first.alias("sum"), none.alias("at")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["at"], F.array(acc["sum"])).alias("at")), lambda acc: acc["at"])

    def summed(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice(xs, k + 1, RUN))
        first = lambda rs: sums(F.transform(rs, lambda r: F.aggregate(r, zero, lambda a, x: a + x)), zero)
        return T.let(runs, lambda rs: F.flatten(F.transform(F.arrays_zip(rs.alias("run"), first(rs).alias("first")), lambda p: sums(p["run"], p["first"]))))

    return T.let(lengths, summed)


def spans(text: Column, java: Column) -> Column:
    """array<struct<start_char, end_char>> of all matches of a pattern for Spark that don't overlap.

    Matches are enclosed in signs that no text has; what lies between the signs has lengths, and places are their sums.
    """
    clean = F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)
    pieces = F.split(F.regexp_replace(clean, F.concat(F.lit("("), java, F.lit(")")), F.lit(f"{_OPEN}$1{_CLOSE}")), _OPEN)

    def placed(ps: Column) -> Column:
        rest = lambda xs: F.slice(xs, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0)))
        lengths = F.transform(ps, lambda x, i: F.length(x).cast("bigint") - (i > 0).cast("bigint"))
        both = F.arrays_zip(rest(ps).alias("x"), rest(running_sums(lengths)).alias("at"))
        return F.transform(both, lambda p: F.struct(p["at"].cast("int").alias("start_char"), (p["at"] + F.instr(p["x"], F.lit(_CLOSE)) - 1).cast("int").alias("end_char")))

    none = F.array().cast("array<struct<start_char:int,end_char:int>>")
    return F.when(text.isNull(), none).otherwise(T.let(pieces, placed))


def highlight_positions(pattern: str, is_regex: bool = True):
    """A function of a text: array<struct<start_char, end_char>> of all matches that highlight() marks; an invalid pattern has none."""
    p = java_pattern(pattern if is_regex else escape(pattern), ignore_case=is_regex) if pattern else None

    def positions(text: Column) -> Column:
        return F.coalesce(spans(text, F.lit(p)), F.array().cast("array<struct<start_char:int,end_char:int>>")) if p else F.array().cast("array<struct<start_char:int,end_char:int>>")

    return positions


def decorated(text: Column, at: Column, prefix: str = ">>> ", suffix: str = " <<<") -> Column:
    """text with what lies at the places of spans() between prefix and suffix."""
    ends = F.concat(F.array(F.lit(0)), F.transform(at, lambda x: x["end_char"]))
    marked = F.transform(at, lambda x, i: F.concat(F.substring(text, F.get(ends, i) + 1, x["start_char"] - F.get(ends, i)), F.lit(prefix), F.substring(text, x["start_char"] + 1, x["end_char"] - x["start_char"]), F.lit(suffix)))
    return F.concat(F.array_join(marked, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))


def focus(text: Column, pattern: str, before: int = 3, after: int = 20) -> Column:
    """Lines around the first match, else the text."""
    p = java_pattern(pattern)
    if p is None:
        return text
    at = F.regexp_instr(text, F.lit(p))
    return F.when(at > 0, context_lines(text, line_of(text, at), before, after)).otherwise(text)


def focus_offset(text: Column, pattern: str, before: int = 50) -> Column:
    """0-based start of a slice that shows the first match; 0 without one."""
    p = java_pattern(pattern)
    return F.lit(0) if p is None else F.greatest(F.lit(0), F.regexp_instr(text, F.lit(p)) - 1 - before)


def capped(text: Column, most: int = FETCHED) -> Column:
    return F.substring(text, 1, most)


def with_fallbacks(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted (id) and texts (id, text, raw) to (id, text): the first text that isn't blank.

    A list of contents (.toc) stands for the file of its name with 0, else for the first whose name begins so. Where a text is
    blank and its name doesn't end in a number, the file of the same name with the least number stands for it; after that
    the raw file's characters without tags, of the file that was last tried.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    bare = F.nullif(T.collapse_spaces(F.regexp_replace("raw", "<[^>]*>", " ")), F.lit(""))
    known = texts.select("id", F.when(~blank("text"), F.col("text")).alias("text"), bare.alias("bare")).filter("id IS NOT NULL")
    ids = wanted.select("id").distinct()
    base = F.regexp_replace("id", r"(\.toc)+\z", "")
    # lengths of names, so few numbers
    lists = ids.filter(F.col("id").endswith(".toc")).select(F.col("id").alias("list"), base.alias("base"))
    lengths = sorted(r[0] for r in lists.select(F.length("base")).distinct().collect())
    begins = F.array(*[F.when(F.length("id") >= n, F.substring("id", 1, n)) for n in lengths]).cast("array<string>")
    order = F.struct((F.col("id") != F.concat("base", F.lit("0"))).alias("later"), F.col("id"))
    contents = known.filter(~F.col("id").endswith(".toc")).select("id", F.explode_outer(begins).alias("base")).join(grams.by_shuffle(lists), "base").groupBy("list").agg(F.min(order).alias("x")).select("list", F.col("x.id").alias("opened"))
    # all of these grow with the texts, so none is broadcast: a copy of the texts would be held by the driver and by each executor
    opened = ids.join(grams.by_shuffle(contents), ids["id"] == contents["list"], "left").select("id", F.coalesce("opened", "id").alias("opened"))
    own = opened.join(grams.by_shuffle(known.select(F.col("id").alias("opened"), "text", "bare")), "opened", "left")
    number = F.regexp_extract("id", r"([0-9]+)\z", 1)
    next_ = known.filter(number != "").select(F.regexp_replace("id", r"[0-9]+\z", "").alias("opened"), F.struct(number.try_cast("bigint").alias("number"), F.col("id"), F.col("text"), F.col("bare")).alias("x")).groupBy("opened").agg(F.min_by("x", F.struct("x.number", "x.id")).alias("x"))
    ends = F.col("opened").rlike(r"[0-9]\z")
    both = own.join(grams.by_shuffle(next_), "opened", "left")
    return both.select("id", F.coalesce("text", F.when(~ends, F.coalesce("x.text", "x.bare")), "bare").alias("text")).filter("text IS NOT NULL")


def fetch_stored(wanted: DataFrame, pages: DataFrame, query: str | None = None, start: int | None = None, most: int = SLICE) -> DataFrame:
    """wanted (url, ...) with a slice of the stored page's text: from start on, else from before the first match of a query.

    pages (key, html) are stored by cache_key() of their url; a url without a page has an empty text.
    """
    plain = F.pandas_udf(lambda s: s.map(hits.article_text), "string")
    stored = pages.select(F.col("key").alias("_key"), plain("html").alias("_text"))
    body = wanted.withColumn("_key", hits.cache_key(F.col("url"))).join(stored, "_key", "left").withColumn("_text", F.coalesce("_text", F.lit(""))).drop("_key")
    if start is None and query and query.strip('" '):
        lo = focus_offset(F.col("_text"), variant_fuzzy(query.strip().strip('"').strip()))
    else:
        lo = F.lit(start or 0)
    total = F.length("_text")
    lo = F.least(lo, total)
    hi = F.least(lo + most, total)
    return body.withColumns({"passage": F.substring(F.col("_text"), lo + 1, hi - lo), "total": total, "start": lo, "end": hi}).drop("_text")


def online_pipeline(docs: DataFrame, pages: DataFrame, query: str, base: str, start: int | None = None, most: int = SLICE) -> DataFrame:
    """The best document of a search (hits.searched()) with the slice of its stored page around the query; no row without documents."""
    best = rank.pick_by_tier(docs, query.strip(), "body", "fascnm", "pos").limit(1)
    return fetch_stored(best.withColumn("url", hits.detail_url(F.coalesce("startid", F.lit("")), base)), pages, query, start, most)


def fetch(docs: DataFrame, doc_id: str, wanted, text: str = "text", line: int | None = None, marker: str | None = None, head: str | None = None, head_index: int | None = None, before: int = 10, after: int = 10, pattern: str | None = None, **slicing) -> DataFrame:
    """One document's passage: a marker goes before a line, that before a head by text or index, else the whole; then highlights and a slice."""
    body = F.col(text)
    if marker is not None:
        body = marker_context(body, marker, before, after)
    elif line is not None:
        body = context_lines(body, F.lit(line), before, after)
    elif head is not None or head_index is not None:
        body = section_by_head(body, head, head_index)
    elif pattern is not None and not slicing:
        body = focus(body, pattern)
    out = docs.filter(F.col(doc_id) == F.lit(wanted)).select(doc_id, body.alias("body"))
    shown = out.withColumn("s", char_slice(F.col("body"), **slicing))
    marked = highlight(F.col("s.slice"), pattern) if pattern else F.col("s.slice")
    return shown.select(doc_id, marked.alias("passage"), F.col("s.total").alias("total"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
