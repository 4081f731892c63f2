"""Corpus files as DataFrames: path, modificationTime, length, content or text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscan.operators import spread

_DECLARED = re.compile(rb"""encoding\s*=\s*["']([A-Za-z0-9._\-]+)["']""")

#: What each kind of corpus takes: a glob of names, patterns that paths must not match, parts that names must not hold.
CORPORA = {
    "plain": ("*.xml", r"$^", ()),
    "sarit": ("*.xml", r"/(\.git|out|schemas|tools)/|header[^/]*template", ()),
    "muktabodha": ("*.{xml,txt}", r"/(\.git|__MACOSX)/", ()),
    "tipitaka": ("*.xml", r"$^", ("toc", "sitemap")),
    "tipitaka_index": ("*.xml", r"$^", ("toc", "sitemap", "tree")),
}


def of_corpus(found: DataFrame, corpus: str = "plain", hint: str | None = None) -> DataFrame:
    """The rows of found (path, ...) that are files of a corpus; hint: only paths that hold it."""
    glob, refused, parts = CORPORA[corpus]
    name = F.element_at(F.split("path", "/"), -1)
    out = found.filter(name.rlike(r"\.(xml|txt)\z" if "txt" in glob else r"\.xml\z") & ~F.col("path").rlike(refused))
    for part in parts:
        out = out.filter(~F.lower(name).contains(part))
    return out.filter(F.col("path").contains(hint)) if hint else out


def files(spark: SparkSession, root: str, corpus: str = "plain", hint: str | None = None) -> DataFrame:
    """The files of a corpus, of all folders below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", CORPORA[corpus][0]).load(root)
    return of_corpus(found, corpus, hint)


def decode_strict(content: Column) -> Column:
    """By byte order mark, else UTF-8; null where the bytes are neither."""
    mark = F.hex(F.substring(content, 1, 2))
    utf8 = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, (1 << 31) - 1)).otherwise(content)
    return F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(utf8.cast("string")), utf8.cast("string"))


def decode(raw: bytes | None) -> str | None:
    """By byte order mark, by the encoding declared in the first 512 bytes, as UTF-8, else as Windows-1252."""
    if raw is None:
        return None
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    if m := _DECLARED.search(raw[:512]):
        try:
            return raw.decode(m[1].decode())
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


decode_lossy = spread.by_text(decode, StringType())


def texts(spark: SparkSession, root: str, corpus: str = "plain") -> DataFrame:
    """path, file_id (the name without its ending), length and text of the files that decode."""
    found = files(spark, root, corpus)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return found.select("path", stem.alias("file_id"), "length", decode_lossy("content").alias("text"))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    from folioscan.sources.catalog import INDEX

    return spark.read.schema(INDEX).parquet(path)


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)
