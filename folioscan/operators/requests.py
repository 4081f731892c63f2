"""Fetching passages of many files by a table of requests.

A file is parsed once, when its marks are indexed: line-break markers, parts and headings, each with its place. A request names
a file, or several of which the first that exists is taken, and what it wants of it: a marker, a line, a part, a heading, or
nothing, for the whole; in this order, where it names more than one. Requests and marks meet in one join of keys (headings
by a text in a second one), and texts join last, so the work before it moves no text. Patterns are translated once for each
request, and everything from the passage on is an expression of its row.

Columns of requests (those that are absent count as null): request_id, id or ids (array); lb, line_number, part, head_query,
head_index; before, after (lines around a marker or line; around a match that the passage is centred on); page and page_size,
start_char, end_char, max_chars (slices), full (no slice); highlight, highlight_regex, prefix, suffix, focus (false: the passage
isn't centred on the first match); plain (line breaks are kept), notes.

Defined cases: a file that doesn't exist and a null id give an empty passage with the method "none"; a marker, part or heading
that the file doesn't have gives the whole text; so does an unknown line an empty one; a pattern that isn't valid marks nothing;
requests that repeat are answered one by one; an empty table gives no rows; other columns of both tables are not read.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import markup
from folioscan.functions import patterns as P
from folioscan.functions import text as T
from folioscan.operators import fetch, spread

MARKS = "kind: string, n: string, line: int, start: int, end: int, value: string"
#: Lines around a marker or a line, and around a match.
AROUND, AROUND_MATCH = (10, 100), (3, 20)
#: When a fetched text is cut to a number of letters (fetch.FETCHED unless it is given), by corpus; others aren't cut.
CUT_BEFORE, CUT_AFTER = frozenset(["tipitaka"]), frozenset(["cbeta", "gretil"])
FIELDS = {
    "lb": "string", "line_number": "int", "part": "string", "head_query": "string", "head_index": "int", "before": "int", "after": "int", "page": "int", "page_size": "int",
    "start_char": "int", "end_char": "int", "max_chars": "int", "full": "boolean", "highlight": "string", "highlight_regex": "boolean", "prefix": "string", "suffix": "string",
    "focus": "boolean", "plain": "boolean", "notes": "boolean",
}

_MARK = re.compile(r"""<(lb|juan)\b([^>]*)>|<head\b[^>]*>(.*?)</head>""", re.S | re.I)
_NUMBER, _FUN = (re.compile(rf"""\b{name}\s*=\s*["']([^"']*)["']""") for name in ("n", "fun"))


def marks_of(xml: str | None) -> list[tuple]:
    """(kind, n, line, start, end, value) of a file's marks, in their order; places count letters from 0.

    lb: where the marker is. juan: from behind the mark that opens the part to the next one that closes any, or the end. head:
    what follows the heading up to the next; n is its number from 0, value its inner text.
    """
    text = xml or ""
    ends = [i for i, c in enumerate(text) if c == "\n"] if "<" in text else []
    out, open_, heads = [], [], []
    line = lambda at: bisect.bisect_left(ends, at) + 1
    for m in _MARK.finditer(text):
        if m[1] is None:
            if heads:
                heads[-1][4] = m.start()
            out.append(["head", str(len(heads)), line(m.start()), m.end(), len(text), m[3]])
            heads.append(out[-1])
            continue
        n, fun = _NUMBER.search(m[2]), _FUN.search(m[2])
        fun = fun[1].lower() if fun else ""
        if m[1].lower() == "lb":
            if n:
                out.append(["lb", n[1], line(m.start()), m.start(), m.end(), None])
        elif fun == "close":
            for x in open_:
                x[4] = m.start()
            open_ = []
        elif n and fun in ("", "open"):
            out.append(["juan", n[1], line(m.start()), m.end(), len(text), None])
            open_.append(out[-1])
    return [tuple(x) for x in out]


def index(files: DataFrame, file_id: str, text: str = "text") -> DataFrame:
    """The marks of files: id, and MARKS. To be stored with the catalogue; a file is parsed where it is."""
    found = spread.by_text(marks_of, f"array<struct<{MARKS}>>")
    return files.select(F.col(file_id).alias("id"), F.col(text).alias("text")).filter("text LIKE '%<%'").select("id", F.inline(found("text")))


def nearest_markers(places: DataFrame, marks: DataFrame) -> DataFrame:
    """places (id, line, ...) with lb: the last marker that begins on the line or before it, else the file's first one.

    An as-of join: a file's markers are one sorted array, in which each place is found by bisection; so a file is as large a
    row as its markers, and its places may be any number.
    """
    per = marks.filter("kind = 'lb'").groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("line", "start", "n"))).alias("_marks"))
    joined = places.join(per, places["id"] == F.col("_id"), "left").drop("_id")
    count = F.size("_marks")
    # bisection: the number of markers up to the line; 31 halvings are enough for any array
    steps = F.sequence(F.lit(1), F.ceil(F.log2(count + 1)).cast("int") + 1)
    lo_hi = F.struct(F.lit(0).alias("lo"), count.alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get("_marks", mid)["line"] <= F.col("line")
        return F.when(acc["lo"] < acc["hi"], F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(mid).alias("hi"))).otherwise(acc)

    upto = F.aggregate(steps, lo_hi, halve)["lo"]
    return joined.withColumn("lb", F.when(count > 0, F.get("_marks", F.greatest(upto - 1, F.lit(0)))["n"])).drop("_marks")


def _pattern(corpus: str):
    """A UDF: a request's pattern for Spark; null where there is none or it is not valid."""

    def one(query, is_regex) -> str | None:
        if query is None or query == "":
            return None
        regex = bool(is_regex) or P.looks_like_regex(query)
        if not regex:
            query = P.variant_fuzzy(query) if corpus == "cbeta" else P.whitespace_fuzzy(query) if re.search(r"\s", query) else P.escape(query)
        return P.java_pattern(query, ignore_case=False)

    return F.pandas_udf(lambda q, r: pd.Series([one(a, b) for a, b in zip(q, r, strict=True)], dtype=object), "string")


def _extracted(kind: str | None, raw: str | None, whole: str | None, plain: bool | None, notes: bool | None) -> str:
    if raw is None:
        return ""
    glyphs = markup.glyphs(whole) if whole and "<charDecl" in whole else {}
    if plain:
        return markup.plain_text(raw, bool(notes), glyphs) or ""
    if kind == "juan":  # a part keeps its notes
        return markup.collapsed_part(raw, glyphs)
    return markup.extract_text(raw, bool(notes), glyphs if kind is None else None) or ""


def _held(rows: DataFrame, *names: str) -> DataFrame:
    """rows, with columns that pass a generator of one row, so that what uses them doesn't evaluate them again."""
    return rows.select(*[F.col(c) for c in rows.columns if c not in names], F.inline(F.array(F.struct(*names))))


def _sliced(length: Column) -> tuple[Column, Column]:
    """(start, end) of a request's slice in letters; see fetch.slice_bounds()."""
    paged = F.col("page").isNotNull() & F.col("page_size").isNotNull()
    big = lambda c: F.col(c).cast("long")
    lo = F.least(F.when(paged, big("page") * big("page_size")).otherwise(F.coalesce(big("start_char"), F.lit(0))), length)
    hi = F.when(paged, big("page") * big("page_size") + big("page_size")).when(F.col("end_char").isNotNull(), big("end_char")).when(F.col("max_chars").isNotNull(), lo + big("max_chars")).otherwise(lo + fetch.SLICE)
    whole = F.coalesce(F.col("full"), F.lit(False))
    lo = F.when(whole, F.lit(0)).otherwise(lo)
    return lo.cast("int"), F.when(whole, length).otherwise(F.greatest(lo, F.least(hi, length))).cast("int")


def fetch_requests(requests: DataFrame, files: DataFrame, marks: DataFrame | None = None, file_id: str = "id", text: str = "text", corpus: str = "cbeta", marked_up: bool = True, most: int | None = fetch.FETCHED) -> DataFrame:
    """A row per request: request_id, id (the file's), method, passage, total, start, end, highlighted, positions.

    marks: index() of the files, else made here. marked_up: texts are extracted from their markup. most: letters of a passage, of
    the corpora whose texts are cut; None for whole passages.
    """
    r = requests.select("request_id", *([F.col("ids")] if "ids" in requests.columns else [F.array("id").alias("ids")]), *[(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
    files = files.select(F.col(file_id).alias("id"), F.col(text).alias("_text"))
    marks = index(files, "id", "_text") if marks is None else marks
    # requests that agree in everything share their answer's parts, so the row itself is the key
    r = r.withColumn("_row", F.sha2(F.to_json(F.struct("request_id", "ids", *FIELDS)), 256))
    named = lambda c: F.nullif(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+\z", ""), F.lit(""))
    r = r.withColumns({"lb": named("lb"), "part": named("part")})
    r = r.withColumn("kind", F.when(F.col("lb").isNotNull(), "lb").when(F.col("line_number").isNotNull(), "line").when(F.col("part").isNotNull(), "juan").when(F.col("head_query").isNotNull(), "query").when(F.col("head_index").isNotNull(), "head"))
    r = r.withColumn("_java", _pattern(corpus)("highlight", "highlight_regex"))

    # the first of the ids that is a file
    tried = r.select("_row", F.posexplode("ids").alias("_at", "id")).join(files.select("id"), "id", "left_semi")
    chosen = tried.distinct().groupBy("_row").agg(F.min_by("id", "_at").alias("id"))

    # marks by one key; of several with one number the first
    padded = F.when(F.length("part") < 3, F.lpad("part", 3, "0")).otherwise(F.col("part"))
    keys = F.when(F.col("kind") == "lb", F.array("lb")).when(F.col("kind") == "juan", F.array("part", padded)).when(F.col("kind") == "head", F.array(F.col("head_index").cast("string")))
    asked = r.select("_row", "kind", "head_query", keys.alias("_keys")).distinct().join(chosen, "_row")
    first = marks.groupBy("id", "kind", "n").agg(F.min(F.struct("start", "end", "line")).alias("m"))
    by_key = asked.filter("_keys IS NOT NULL").select("_row", "id", "kind", F.explode(F.array_distinct("_keys")).alias("n")).join(first, ["id", "kind", "n"]).groupBy("_row").agg(F.min("m").alias("m"))
    heads = marks.filter("kind = 'head'").select("id", "start", "end", "line", "value")
    by_text = asked.filter("kind = 'query'").select("_row", "id", "head_query").join(heads, "id").filter(F.contains(F.lower("value"), F.lower("head_query"))).groupBy("_row").agg(F.min(F.struct("start", "end", "line")).alias("m"))
    found = by_key.unionByName(by_text)

    out = r.join(chosen, "_row", "left").join(found, "_row", "left").join(files, "id", "left")
    around = lambda c, k: F.coalesce(F.col(c), F.lit(AROUND[k]))
    lines = fetch.context_lines(F.col("_text"), F.when(F.col("kind") == "lb", F.col("m.line")).otherwise(F.col("line_number")), around("before", 0), around("after", 1))
    section = F.substring(F.col("_text"), F.col("m.start") + 1, F.col("m.end") - F.col("m.start"))
    by_line = (F.col("kind") == "line") | ((F.col("kind") == "lb") & F.col("m").isNotNull())
    by_mark = F.col("kind").isin("juan", "head", "query") & F.col("m").isNotNull()
    out = out.withColumn("_found", F.when(by_line | by_mark, F.col("kind"))).withColumn("_raw", F.when(by_line, lines).when(by_mark, section).otherwise(F.col("_text")))
    if marked_up:
        read = spread.by_text(_extracted, "string")
        out = out.withColumn("_body", read("_found", "_raw", F.when(F.col("_text").contains("<charDecl"), F.col("_text")), "plain", "notes"))
    else:
        out = out.withColumn("_body", F.coalesce("_raw", F.lit("")))
    out = out.drop("_text", "_raw")

    # a match that is far from the beginning is what the passage is centred on
    at = F.when(F.col("_java").isNotNull(), F.regexp_instr("_body", F.col("_java"))).otherwise(F.lit(0))
    may = F.coalesce("focus", F.lit(True)) & ~F.coalesce("full", F.lit(False)) & F.col("lb").isNull() & F.col("line_number").isNull() & F.coalesce("start_char", "end_char", "max_chars").isNull()
    centred = fetch.context_lines(F.col("_body"), fetch.line_of(F.col("_body"), F.col("_at")), F.coalesce("before", F.lit(AROUND_MATCH[0])), F.coalesce("after", F.lit(AROUND_MATCH[1])))
    out = _held(out.withColumn("_at", F.when(may, at).otherwise(F.lit(0))), "_body", "_at").withColumn("_focus", F.when(F.col("_at") > 0, centred))
    focused = F.trim("_focus") != ""
    name = F.when(F.coalesce(focused, F.lit(False)), "highlight-context").when(F.col("id").isNull(), "none").when(F.col("_found") == "lb", "lb-context").when(F.col("_found") == "line", "line-context").when(F.col("_found") == "juan", "part").when(F.col("_found") == "query", "head-query").when(F.col("_found") == "head", "head-index").otherwise("full")
    out = out.withColumns({"method": name, "_body": F.when(F.coalesce(focused, F.lit(False)), F.col("_focus")).otherwise(F.col("_body"))})
    out = _held(out, "method", "_body")
    lo, hi = _sliced(F.length("_body"))
    out = out.withColumns({"total": F.length("_body"), "start": lo, "end": hi})
    out = out.withColumn("_slice", F.substring(F.col("_body"), F.col("start") + 1, F.col("end") - F.col("start")))
    if corpus in CUT_BEFORE and most is not None:
        out = out.withColumn("_slice", fetch.capped(F.col("_slice"), most))
    out = _held(out, "total", "start", "end", "_slice")
    java = F.coalesce("_java", F.lit("(?!)"))
    out = out.withColumn("positions", fetch.spans(F.col("_slice"), java))
    mark = lambda c, d: F.regexp_replace(F.coalesce(c, F.lit(d)), r"([\\$])", r"\\$1")
    shown = F.when(F.col("_java").isNull(), F.col("_slice")).otherwise(F.regexp_replace(F.col("_slice"), F.concat(F.lit("("), java, F.lit(")")), F.concat(mark("prefix", ">>> "), F.lit("$1"), mark("suffix", " <<<"))))
    out = out.withColumn("passage", fetch.capped(shown, most) if corpus in CUT_AFTER and most is not None else shown)
    return out.select("request_id", "id", "method", "passage", "total", "start", "end", F.size("positions").alias("highlighted"), "positions")
