"""Line search over plain files of any size, cut into ranges of bytes.

Spark's text reader gives each range the lines that begin in it. A line's number is its place in its range and the lines of
the ranges before it; only ranges are counted and summed up, and only lines that match move. search.grep() reads a file as
one row instead, which is for files that fit into one.

Defined cases: as in search.grep(), a file with a NUL in it has no matches, lines end with a line feed (a carriage return before
it goes), and what follows the last one is a line unless it is empty; an invalid pattern matches nothing; bytes that aren't
UTF-8 are read as the replacement character; empty files and folders give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.operators import search


def _ranges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, at (where the range begins), seq (ascending within a range) and line."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    m = F.col("_metadata")
    return raw.select(m["file_path"].alias("path"), m["file_block_start"].alias("at"), F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "\r\\z", "").alias("line"))


def _offsets(rows: DataFrame) -> DataFrame:
    """path, at, first (the range's first seq), before (lines in the ranges before it), of files without a NUL: a row per range."""
    per = rows.groupBy("path", "at").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.max(F.col("line").contains("\0")).alias("binary"))
    whole = Window.partitionBy("path")
    before = F.sum("n").over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return per.select("path", "at", "first", F.coalesce(before, F.lit(0)).alias("before"), F.max("binary").over(whole).alias("binary")).filter(~F.col("binary")).drop("binary")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_number (from 1) and line of all files."""
    rows = _ranges(spark, paths)
    return rows.join(_offsets(rows), ["path", "at"]).select("path", (F.col("before") + F.col("seq") - F.col("first") + 1).alias("line_number"), "line")


def hits(spark: SparkSession, paths: str | list[str], pattern: str, most: int | None = None) -> DataFrame:
    """path, line_number, context and highlight of the matching lines, the first of each file if there is a cap."""
    rows = _ranges(spark, paths)
    found = search.grep(rows.withColumnRenamed("line", "text"), pattern, 1).select("path", "at", "seq", F.col("matches")[0].alias("m"))
    placed = found.join(_offsets(rows), ["path", "at"]).select("path", (F.col("before") + F.col("seq") - F.col("first") + 1).alias("line_number"), "m.context", "m.highlight")
    if most is None:
        return placed
    return placed.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line_number"))).filter(F.col("_n") <= most).drop("_n")
