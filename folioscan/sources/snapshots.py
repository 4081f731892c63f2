"""Catalogues as snapshots: what has changed since the last one is parsed, the rest is carried over.

A snapshot is a folder of its own under the catalogue's, with a row per file: path, modificationTime, length and the entry. A
file is unchanged where all three are; files that have gone leave no row. The newest snapshot is named by a small file that
is replaced at once, after the snapshot is whole, so a reader sees the old one or the new one, and a run that dies changes
nothing. Snapshots by another version of the corpus's rules are not carried over.

Contents are read of files that were modified when the oldest of the changed ones was, or later, as Spark's reader skips
others by that time alone; of these only the changed ones are decoded and parsed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.sources import catalog, readers

STAMP = ["path", "modificationTime", "length"]
POINTER = "_current"
#: What an index was built by: it changes when a corpus's rules do.
RULES = 1


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _current_path(spark: SparkSession, folder: str) -> str | None:
    p, fs = _hadoop(spark, f"{folder}/{POINTER}")
    if not fs.exists(p):
        return None
    java = spark._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(fs.open(p)))
    try:
        return f"{folder}/{reader.readLine()}"
    finally:
        reader.close()


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest snapshot (STAMP, rules, id, title, meta), or None."""
    path = _current_path(spark, folder)
    return None if path is None else spark.read.parquet(path)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The newest snapshot as catalog.INDEX; empty without one."""
    found = current(spark, folder)
    return spark.createDataFrame([], catalog.INDEX) if found is None else found.select("id", "title", "path", "meta")


def changes(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """path, modificationTime and length of now's files that before doesn't have as they are."""
    return now if before is None else now.join(before.filter(F.col("rules") == RULES).select(STAMP), STAMP, "left_anti")


def _point(spark: SparkSession, folder: str, name: str) -> None:
    """Let the pointer name a snapshot: written beside it, then moved over it in one step."""
    jvm = spark._jvm
    new, fs = _hadoop(spark, f"{folder}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"), rename)


def refresh(spark: SparkSession, root: str, folder: str, corpus: str = "plain", files: str | None = None) -> dict[str, int]:
    """Make the catalogue in folder that of the files below root: how many were parsed, carried over and dropped.

    files: the kind of readers.CORPORA whose files are taken, that of the corpus where it has one.
    """
    kind = files or (corpus if corpus in readers.CORPORA else "plain")
    found = readers.files(spark, root, kind)
    now, before = found.select(STAMP), current(spark, folder)
    new = changes(now, before)
    known = new.agg(F.count("*").alias("n"), F.min("modificationTime").alias("oldest")).first()
    gone = before.join(now, "path", "left_anti").count() if before is not None else 0
    if before is not None and not known["n"] and not gone:
        return {"parsed": 0, "kept": before.count(), "gone": 0}
    texts = found.filter(F.col("modificationTime") >= F.lit(known["oldest"])) if known["n"] else found.limit(0)
    texts = texts.join(new.select("path"), "path", "left_semi").select("path", readers.decode_lossy("content").alias("text"))
    parsed = new.join(catalog.build(texts, corpus, root), "path").withColumn("rules", F.lit(RULES))
    columns = [*STAMP, "rules", "id", "title", "meta"]
    rows = parsed.select(columns)
    if before is not None:
        rows = rows.unionByName(before.filter(F.col("rules") == RULES).join(now, STAMP, "left_semi").select(columns))
    name = f"snapshot-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    _point(spark, folder, name)
    return {"parsed": known["n"], "kept": spark.read.parquet(f"{folder}/{name}").count() - known["n"], "gone": gone}


def clean(spark: SparkSession, folder: str) -> int:
    """Delete the snapshots that aren't the newest: how many. Not while another run reads or refreshes."""
    keep = (_current_path(spark, folder) or "").rpartition("/")[2]
    p, fs = _hadoop(spark, folder)
    stale = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(("snapshot-", f"{POINTER}-")) and s.getPath().getName() != keep] if fs.exists(p) else []
    for path in stale:
        fs.delete(path, True)
    return len(stale)
