"""Substring dedup with difference-cover anchors (operator 8).

PERIOD and COVER are a difference cover: for any two places in two documents there is a shift below PERIOD that brings
both to cover places. So two equal runs of WINDOW words hold, at the same shift, an equal anchor: a run of ANCHOR =
WINDOW - PERIOD + 1 words that starts at a cover place of either document. Only anchors are hashed and shuffled in the
first phase (6 of 31 places). Those seen in two documents or more are extended in the second phase: the windows around
them are hashed, and the smallest document of each window is found. A window goes if that is smaller than its own.

Phases are written tables, and anchors are written once. Minima are aggregated before they shuffle, and the joins back are
plain equi-joins that the adaptive skew join splits for hot anchors and windows. Anchors are 64-bit hashes of their words,
as one that agrees by chance only brings more windows; windows are judged by 128 bits, mixed of 128 bits of each word.

Defined cases: null, blank and short texts have no windows and keep their words; a very long text is judged whole; a null
doc_id is neither smaller nor larger than any other; equal windows within a document, and in rows of one doc_id, stay;
rows that repeat a doc_id are judged row by row, by their own texts; an empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import common, wordhash

WINDOW, PERIOD = 50, 31
#: Every difference modulo PERIOD is one of two of these.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1


def _emit(part: pa.RecordBatch, counts: np.ndarray, hashes: list[np.ndarray], places: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(np.repeat(np.arange(len(counts)), counts))
    return pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hashes), part.column(0).take(rows), part.column(1).take(rows), pa.array(places.astype(np.int32))], ["hash", "other"][: len(hashes)] + ["doc_id", "key", "place"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    for batch in batches:
        for part, words, _, before in wordhash.hashed_batches(batch, 2):
            (runs,) = wordhash.run_hashes(ANCHOR, words)
            n = np.diff(before)
            place = np.arange(len(words)) - np.repeat(before[:-1], n)
            left = np.repeat(before[1:], n) - np.arange(len(words))  # words from here to the document's end
            keep = cover[place % PERIOD] & (left >= ANCHOR) & np.repeat(n >= WINDOW, n)
            at = np.flatnonzero(keep)
            yield _emit(part, np.diff(np.searchsorted(at, before)), [runs[at]], place[at])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text, places of repeated anchors) to the windows that hold one of them."""
    for batch in batches:
        for part, *words, before in wordhash.hashed_batches(batch, 2):
            runs = wordhash.run_hashes(WINDOW, *words)
            ats, counts = [], []
            for i, places in enumerate(part.column(3)):
                lo, n = before[i], before[i + 1] - before[i]
                mark = np.zeros(max(n, 0) + 1, dtype=np.int32)
                p = places.values.to_numpy().astype(np.int64)
                np.add.at(mark, np.maximum(p - (WINDOW - ANCHOR), 0), 1)
                np.add.at(mark, p + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[: max(n - WINDOW + 1, 0)] > 0)
                ats.append(at + lo)
                counts.append(len(at))
            at = np.concatenate(ats) if ats else np.empty(0, dtype=np.int64)
            yield _emit(part, np.asarray(counts), [r[at] for r in runs], at - np.repeat(before[:-1], counts))


def kept_mask(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    mark = np.zeros(n + 1, dtype=np.int32)
    s = starts[starts + window <= n]
    np.add.at(mark, s, 1)
    np.add.at(mark, s + window, -1)
    return np.cumsum(mark)[:n] == 0


def _removed(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts, ends, before in wordhash.spans_of(batch, 1):
                out, kept = [], []
                for i, places in enumerate(part.column(2)):
                    lo, n = before[i], int(before[i + 1] - before[i])
                    s, e = starts[lo : lo + n], ends[lo : lo + n]
                    if places.is_valid:
                        keep = kept_mask(n, places.values.to_numpy().astype(np.int64), WINDOW)
                        s, e = s[keep], e[keep]
                    raw = data[s[0] : e[-1]].tobytes() if len(s) else b""
                    text = b" ".join(raw.split()) if not places.is_valid else b" ".join(data[a:b].tobytes() for a, b in zip(s, e, strict=True))
                    out.append((n, n - len(s), hashlib.sha256(text).hexdigest()))
                    kept.append(text.decode() if with_text else None)
                cols = [part.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, key, text) to (doc_id, key, starts): the places of windows that also start in a document with a smaller doc_id."""
    rows = rows.filter("doc_id IS NOT NULL")
    anchors = common.materialise(common.map_arrow(rows, _anchors, "hash long, doc_id long, key long, place int"), "substring-anchors")
    shared = anchors.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("hash")
    shared = common.materialise(shared, "substring-shared")  # a table of its own: skew joins split only what comes from an exchange
    found = common.materialise(anchors.join(shared, "hash").groupBy("doc_id", "key").agg(F.collect_set("place").alias("places")), "substring-places")
    common.drop(anchors, shared)
    texts = rows.join(found.hint("shuffle_hash"), ["doc_id", "key"]).select("doc_id", "key", "text", "places")
    windows = common.materialise(common.map_arrow(texts, _windows, "hash long, other long, doc_id long, key long, place int"), "substring-windows")
    least = windows.groupBy("hash", "other").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("hash", "other", "lo")
    least = common.materialise(least, "substring-least")
    later = windows.join(least, ["hash", "other"]).filter("lo < doc_id")
    starts = common.materialise(later.groupBy("doc_id", "key").agg(F.collect_set("place").alias("starts")), "substring-starts")
    common.drop(found, windows, least)
    return starts


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256; with_text: kept_text too."""
    body = F.coalesce(F.col(text), F.lit(""))
    # rows of a doc_id are told apart by their texts, if any doc_id repeats; rows that agree in both lose the same words
    again = docs.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).count().filter("count > 1")
    key = F.lit(0).cast("long") if again.isEmpty() else F.xxhash64(body)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"), body.alias("text"))
    starts = repeated_windows(rows).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "starts")
    joined = rows.join(starts.hint("shuffle_hash"), (rows["doc_id"] == starts["_id"]) & (rows["key"] == starts["_key"]), "left").select("doc_id", "text", "starts")
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return common.map_arrow(joined, _removed(with_text), fields)


def query(spark, sf_dir):
    return dedup(common.read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), v AS (
  SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50
), h AS (
  SELECT r, doc_id, k, sha256(array_to_string(w[k:k + 49], ' ')) AS h FROM v
), g AS (
  SELECT r, k FROM (SELECT r, doc_id, k, min(doc_id) OVER (PARTITION BY h) AS least FROM h) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT r, unnest(range(k, k + 50)) AS p FROM g
), kept AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
