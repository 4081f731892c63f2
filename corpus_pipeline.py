"""From documents to token ids: toxicity, exact dedup, near-dedup, mixing of sources, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. run() deletes a stage's own tables, and the documents that
it has read, once its result is written.

Defined cases, in every stage: null, empty and blank texts are documents without words: they are not toxic by their words,
are copies of each other, have no near copies, are taken 0 times by the mix (size 0) and so end there; null doc_ids are
kept apart by their texts in exact dedup, stay in near-dedup, and are mixed and encoded row by row; rows that repeat a
doc_id are judged by their own texts; of ties the rules of the operators decide (the longest text, then the smallest
doc_id); very long texts are read whole; an empty table gives an empty one; columns beyond those of documents, whatever
their names, are carried by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import byte_bpe, common, exact_dedup, minhash_dedup, mixing, toxicity

#: Jaccard similarity of near copies, in percent; op6's query has a threshold of its own.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject(docs, toxicity.fit(docs, common.read_table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash_dedup.dedup(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: its token ids, with op5's counts and digests."""
    return byte_bpe.encode(docs, *byte_bpe.tokenizer(), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("minhash_dedup", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL can't express the model, the signatures, the random rounding and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with common.scratch() as kept:
            before, docs = docs, common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        if k:
            common.drop(before)
    return docs
