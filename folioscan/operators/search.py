"""Line search over a corpus: lines, a pattern, a cap per file, counts, an order and a limit.

A file's lines are an array of its row, so that the filter and the cap are expressions of one row: no line is ever
shuffled, and hot or long files stay where they are. Only the ordered limit moves rows, those of the limit per task.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import markup
from folioscan.functions import text as T
from folioscan.functions.patterns import java_pattern
from folioscan.operators.fetch import marker_near

#: Defaults of a search and of a search-to-context pipeline: files, and matches of a file.
SEARCH_LIMITS, PIPELINE_LIMITS = (20, 5), (10, 3)
#: Characters of an inline answer, and of the preview in its place.
INLINE, PREVIEW = 12_000, 1_200
#: Least characters of a snippet.
SNIPPET = 120


#: What makes a match depend on where a line or the text ends or begins, or on what is around the match.
_EDGES = re.compile(r"[\^$]|\\[AZzGB]")


def matches(text: Column, pattern: str, most: int | None) -> Column:
    """array<struct<line_number, context, highlight>> of the first matching lines; a file with a NUL has none.

    Lines are filtered and cut to the cap first, so that only those that are shown are trimmed and marked. A line matches
    if it does without the white space at its end, or if the match in it as it stands isn't empty.
    """
    p = java_pattern(pattern)
    kind = "array<struct<line_number:int,context:string,highlight:string>>"
    if p is None or most == 0:
        return F.array().cast(kind)
    trimmed = lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")
    # the first group is the whole match, so that groups of the pattern don't matter
    marked = lambda x: F.regexp_extract(x, f"({p})", 1)
    hit = (lambda x: trimmed(x).rlike(p) | (marked(x) != "")) if _EDGES.search(pattern) else (lambda x: x.rlike(p))
    numbered = F.transform(T.lines(text), lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("x")))
    found = F.filter(numbered, lambda m: hit(m["x"]))
    found = found if most is None else F.slice(found, 1, most)
    shown = F.transform(found, lambda m: F.struct(m["n"].alias("line_number"), trimmed(m["x"]).alias("context"), marked(m["x"]).alias("highlight")))
    may = ~text.contains("\0") if _EDGES.search(pattern) else ~text.contains("\0") & text.rlike(p)
    return F.when(may, shown).otherwise(F.array().cast(kind))


def grep(files: DataFrame, pattern: str, most: int | None = SEARCH_LIMITS[1], text: str = "text") -> DataFrame:
    """files with a match, with matches and total_matches (capped like the matches).

    The matches pass a generator of one row, so that filtering on them doesn't evaluate them again.
    """
    out = files.select("*", F.explode(F.array(matches(F.col(text), pattern, most))).alias("matches"))
    return out.withColumn("total_matches", F.size("matches")).filter("total_matches > 0")


def hits(files: DataFrame, pattern: str, file_id: str, most: int | None = None, text: str = "text") -> DataFrame:
    """A row per matching line: the file's id, line_number, context, highlight."""
    return grep(files, pattern, most, text).select(F.col(file_id), F.inline("matches"))


def best_first(found: DataFrame, file_id: str, limit: int = SEARCH_LIMITS[0]) -> DataFrame:
    """Most matches first, then by id."""
    return found.orderBy(F.desc("total_matches"), F.asc(file_id)).limit(limit)


def path_order(found: DataFrame, path: str, limit: int = SEARCH_LIMITS[0]) -> DataFrame:
    return found.orderBy(path).limit(limit)


def tiered(found: DataFrame, tier: Column, file_id: str, limit: int = SEARCH_LIMITS[0], prefix: str | None = None) -> DataFrame:
    """Files of the first tier fill the limit, the others what is left of it: one order selects the same rows as two searches.

    prefix: what is selected is shown with the ids that begin so first, whatever their tier.
    """
    chosen = found.withColumn("tier", tier).orderBy("tier", F.desc("total_matches"), F.asc(file_id)).limit(limit)
    return chosen if prefix is None else chosen.orderBy(~F.col(file_id).startswith(prefix), F.desc("total_matches"), F.asc(file_id))


def structured(found: DataFrame, file_id: str, text: str = "text") -> DataFrame:
    """found with title (of the file's first texts, else its id), structure_info ("n(type)" of its divisions) and, in each match, section, the first of them."""
    read = F.pandas_udf(lambda s: pd.DataFrame([markup.structure(x) for x in s], columns=["title", "structure_info"]), "title string, structure_info array<string>")
    out = found.withColumn("_read", read(F.col(text)))
    section = F.get(F.col("_read.structure_info"), F.lit(0))
    shown = {"title": F.coalesce(F.nullif(F.col("_read.title"), F.lit("")), F.col(file_id).cast("string")), "structure_info": F.col("_read.structure_info"), "matches": F.transform("matches", lambda m: m.withField("section", section))}
    return out.withColumns(shown).drop("_read")


def size_hint(text: Column) -> Column:
    return F.concat(F.floor(F.octet_length(text) / 1024).cast("string"), F.lit("KB"))


def suggestions(found: DataFrame, file_id: str, top: int = 1, before: int = 1, after: int = 3) -> DataFrame:
    """What to fetch of the top files: lines around the first match."""
    first = F.col("matches")[0]["line_number"]
    return best_first(found, file_id, top).select(file_id, first.alias("line_number"), F.greatest(first - before, F.lit(1)).alias("from_line"), (first + after).alias("to_line"))


def with_markers(found: DataFrame) -> DataFrame:
    """found, with lb in each match: the first line-break marker of its line, null without one."""
    return found.withColumn("matches", F.transform("matches", lambda m: m.withField("lb", marker_near(m["context"], F.lit("")))))


def marked_suggestions(found: DataFrame, file_id: str, top: int = 1) -> DataFrame:
    """What to fetch of the top files: by the marker near the first match, or by its line where there is none."""
    m = F.col("matches")[0]
    lb = marker_near(m["context"], m["highlight"])
    return best_first(found, file_id, top).select(file_id, lb.alias("lb"), F.when(lb.isNull(), m["line_number"]).alias("line_number"))


def summary(found: DataFrame, shown: int = 2, width: int = 100) -> DataFrame:
    """found with summary: the first matches, cut, and how many more there are."""
    lines_ = F.transform(F.slice("matches", 1, shown), lambda m: F.substring(m["context"], 1, width))
    more = F.when(F.col("total_matches") > shown, F.concat(F.lit("... and "), (F.col("total_matches") - shown).cast("string"), F.lit(" more")))
    return found.withColumn("summary", F.concat_ws("\n", lines_, more))


def context(files: DataFrame, wanted: DataFrame, file_id: str, before: int, after: int, text: str = "text") -> DataFrame:
    """wanted (file_id, line_number) with passage: the lines around it. Clamped; a line outside the file gives an empty passage.

    The join is on the file; the range of lines is a slice of the file's own row.
    """
    all_lines = T.lines(F.col(text))
    n, total = F.col("line_number"), F.size(all_lines)
    lo, hi = F.greatest(n - before, F.lit(1)), F.least(n + after, total)
    inside = (n >= 1) & (n <= total)
    passage = F.when(inside, F.array_join(F.slice(all_lines, F.when(inside, lo).otherwise(F.lit(1)), F.when(inside, hi - lo + 1).otherwise(F.lit(0))), "\n")).otherwise(F.lit(""))
    return wanted.join(files.select(file_id, text), file_id).withColumn("passage", passage).drop(text)


def search_to_context(files: DataFrame, pattern: str, file_id: str, limits: tuple[int, int] = PIPELINE_LIMITS, before: int = 1, after: int = 3, marks: tuple[str, str] = (">>> ", " <<<"), text: str = "text", snippet: int | None = None) -> DataFrame:
    """The best files' matches with their highlighted surroundings, in one text per file.

    snippet: of each surrounding only so many characters, SNIPPET at least, are shown.
    """
    best = best_first(grep(files, pattern, limits[1], text), file_id, limits[0])
    p = java_pattern(pattern)
    all_lines = T.lines(F.col(text))

    def around(m: Column) -> Column:
        lo = F.greatest(m["line_number"] - before, F.lit(1))
        hi = F.least(m["line_number"] + after, F.size(all_lines))
        passage = F.array_join(F.slice(all_lines, lo, hi - lo + 1), "\n")
        return passage if snippet is None else F.substring(passage, 1, max(snippet, SNIPPET))

    joined = F.array_join(F.transform("matches", around), "\n---\n")
    shown = F.regexp_replace(joined, f"({p})", f"{marks[0]}$1{marks[1]}") if p else joined
    return best.select(file_id, "total_matches", shown.alias("passages"))


def spill(answers: DataFrame, payload: str, inline: int = INLINE, preview: int = PREVIEW) -> DataFrame:
    """answers with key, spilled and shown: payloads over the limit are shown as a preview and stored under their key."""
    over = F.length(payload) > inline if inline > 0 else F.lit(False)
    return answers.withColumns({"key": F.substring(F.sha1(F.col(payload).cast("binary")), 1, 12), "spilled": over, "shown": F.when(over, F.substring(payload, 1, preview)).otherwise(F.col(payload))})


def spill_to(answers: DataFrame, payload: str, path: str, inline: int = INLINE, preview: int = PREVIEW) -> DataFrame:
    """spill(), with the payloads over the limit stored in a table at path: key (the SHA-1) and payload.

    The table is addressed by content: a payload is stored once, however often it is answered or the run is repeated, and what
    is stored is never rewritten. Runs that write one table at the same time may store a payload twice.
    """
    spark = answers.sparkSession
    digest = F.sha1(F.col(payload).cast("binary"))
    over = answers.filter(F.length(payload) > inline) if inline > 0 else answers.limit(0)
    new = over.select(digest.alias("key"), F.col(payload).alias("payload")).dropDuplicates(["key"])
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = new.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    new.write.mode("append").parquet(path)
    return spill(answers, payload, inline, preview).withColumn("key", F.when(F.col("spilled"), digest))
