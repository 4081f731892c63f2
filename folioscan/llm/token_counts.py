"""Token counts through a digest cache (operator 3).

A stored table holds token counts by content digest, in a folder for each tokenizer version digest. Every text is brought into a normal form
that can't change its count (runs of ASCII white space become one space, none at the ends: the tokenizer does the same),
digested, and joined to the stored counts. Only distinct digests that are missing there are encoded, one document's text
for each, and their counts are appended to the table. The texts move once, for the documents that stand for a miss;
everything else is digests.

Encoding goes word by word (between ASCII white space), as this tokenizer drops white space and never merges across it;
a worker remembers the counts of words. Special strings in a text are found by the library, as is its default.

Defined cases: null text is the empty text, with no tokens; a very long text is counted whole, word by word; equal texts
are encoded once, that of the smallest doc_id; documents that repeat a doc_id get the count of their own
text; an empty table gives no rows; the cache may be absent, empty, or hold a digest twice after two runs at once (its
counts agree, one is read). Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import common

OVER = 2048
_CACHE = "digest binary, n_tokens long"
_loaded: dict = {}


class Counting:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), common.Memory(64 << 20)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, text: bytes) -> int:
        words, known = text.split(), self.known
        counts = list(map(known.get, words))
        if None not in counts:
            return sum(counts)
        total, new = sum(filter(None, counts)), []
        unknown = Counter(w for w, c in zip(words, counts, strict=True) if c is None)
        for w, n in unknown.items():
            c = known.recall(w, len(w) + 64)
            if c is None:
                new.append(w)
            else:
                total += c * n
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                total += len(e.ids) * unknown[w]
                known.place(w, len(e.ids), len(w) + 64)
        return total


def counting(path: str) -> Counting:
    if path not in _loaded:
        _loaded[path] = Counting(path)
    return _loaded[path]


@functools.lru_cache
def version_of(path: str) -> str:
    """Digest of the tokenizer's file: counts of another version are never read."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counting(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t.as_py()) for t in b.column(1)], pa.int64())], ["digest", "n_tokens"])

    return run


def _normal(text):
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts of one version, which are a folder of their own in the cache."""
    folder = f"{cache.rstrip('/')}/version={version}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHE)
    return spark.read.schema(_CACHE).parquet(folder).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens. Appends the counts that were missing to the table at cache."""
    spark, version = docs.sparkSession, version_of(path)
    source = F.col(text)
    digest = F.unhex(F.sha2(_normal(source), 256)).alias("digest")
    light = common.materialise(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(source), F.lit(0)).cast("long").alias("n_bytes"), digest), "tokens-digests")
    missing = light.groupBy("digest").agg(F.min("doc_id").alias("_id")).join(_stored(spark, cache, version), "digest", "left_anti")
    missing = common.materialise(missing, "tokens-missing")
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(source, F.lit("")).cast("binary").alias("_text"), digest)
    # the document that stands for a digest, by id and digest; rows that repeat both are encoded again, and stored once
    wanted = texts.join(missing.hint("shuffle_hash"), ["_id", "digest"], "left_semi").select("digest", "_text")
    unnamed = missing.filter("_id IS NULL").select("digest")
    if not unnamed.isEmpty():
        wanted = wanted.unionByName(texts.filter("_id IS NULL").join(unnamed, "digest", "left_semi").select("digest", "_text"))
    fresh = common.map_arrow(wanted, _encode(path), _CACHE).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    fresh.write.mode("append").parquet(f"{cache.rstrip('/')}/version={version}")
    # a table of its own, so that the join's sides are plain and the adaptive skew join splits a digest of many copies
    counts = common.materialise(_stored(spark, cache, version), "tokens-counts")
    return light.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def query(spark, sf_dir):
    """With an empty cache, so that every distinct text is encoded."""
    import public_tokenizers

    counts = count_tokens(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), common.new_table(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER)
