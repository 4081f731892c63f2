"""Exact dedup by two-pass Bloom filtering (operator 9, native).

Pass 1 sets two bits of one 64-bit word for each row's hash and keeps the bits that two insertions hit: the filter of
possibly repeated hashes. Insertions that agree in word and bits are summed before they shuffle, and a word sees at most
as many different ones as there are pairs of its bits. Pass 2 tests every row against that filter. Rows outside it are
unique for certain and pass straight through; only the others shuffle, by their exact SHA-256, and are grouped.

The filter has a word for each row, whatever their number, and holds only words with such bits: some 2 % of the words
beside those of copies. It is a table; up to FILTER_ROWS rows of it are broadcast (two longs each), beyond that rows and
filter meet by word in a plain join, which the adaptive skew join splits for hot texts. Texts are digested once for
decide(), whose rows are keys and digests from then on.

Defined cases: null text counts as empty; empty and blank texts are equal to each other; a very long text is digested
whole; the longest original text stays, on ties the smallest doc_id, a null doc_id after all others; an empty table gives
no rows. decide() marks all rows kept that repeat the doc_id of the row that stays; dedup() leaves one row of each group,
also of rows that agree in all columns. Input columns beyond those named, also ones called like the results, are left
alone: decide() returns only its own columns, and dedup() the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm import common

#: Rows of the filter that are broadcast at most.
FILTER_ROWS = 1 << 21


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, "")


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """rows (with digest) with _word and _mask: the word of the filter that the digest falls into, and its two bits."""
    two = F.xxhash64(F.lit(1), F.col("digest"))
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_two, {6 * k}) & 63 AS int))") for k in range(2)]
    return rows.withColumn("_word", F.pmod(F.xxhash64(F.lit(0), F.col("digest")), F.lit(words))).withColumn("_two", two).withColumn("_mask", bits[0].bitwiseOR(bits[1])).drop("_two")


def repeated_filter(digests: DataFrame, words: int) -> DataFrame:
    """(word, twice): the bits that two or more insertions hit, of the words that have any."""
    each = _marked(digests, words).groupBy("_word", "_mask").agg((F.count("*") > 1).alias("again"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("twice"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.when(x["again"], x["_mask"]).otherwise(acc["seen"].bitwiseAND(x["_mask"]))
        return F.struct(acc["seen"].bitwiseOR(x["_mask"]).alias("seen"), acc["twice"].bitwiseOR(hit).alias("twice"))

    per = each.groupBy(F.col("_word").alias("word")).agg(F.collect_list(F.struct("_mask", "again")).alias("masks"))
    return per.select("word", F.aggregate("masks", start, step)["twice"].alias("twice")).filter("twice <> 0")


class Filter:
    """The stored filter of a table's stored digests."""

    def __init__(self, digests: DataFrame):
        self.words = max(1, digests.count())
        self.table = common.materialise(repeated_filter(digests, self.words), "dedup-filter")
        self.small = self.table.count() <= FILTER_ROWS

    def tested(self, rows: DataFrame) -> DataFrame:
        """rows (with digest) and a column _maybe: the digest may be repeated."""
        side = F.broadcast(self.table) if self.small else self.table
        maybe = F.coalesce(F.col("twice").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
        return _marked(rows, self.words).join(side, F.col("_word") == F.col("word"), "left").withColumn("_maybe", maybe).drop("_word", "_mask", "word", "twice")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _order() -> Column:
    """Greatest for the row that stays."""
    return F.struct(F.col("n_points"), F.col("_id").isNotNull().alias("has_id"), (-F.col("_id")).alias("minus"))


def _light(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("_id"), F.coalesce(F.length(F.col(text)), F.lit(0)).alias("n_points"), _digest(F.col(text)).alias("digest")]


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    light = common.materialise(docs.select(_light(docs, doc_id, text)), "dedup-digests")
    tested = Filter(light.select("digest")).tested(light)
    suspects = common.materialise(tested.filter("_maybe").drop("_maybe"), "dedup-suspects")
    # a table of its own: a skew join splits hot digests only where both sides come straight from an exchange
    winners = common.materialise(suspects.groupBy("digest").agg(F.max_by("_id", _order()).alias("keep_id"), F.count("*").alias("group_size")), "dedup-winners")
    alone = tested.filter("NOT _maybe").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    grouped = suspects.join(winners, "digest").select("_id", "keep_id", "group_size", "digest")
    return alone.unionByName(grouped).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with docs' columns. Digests shuffle, and whole rows only if they may be repeated."""
    digests = common.materialise(docs.select(_digest(F.col(text)).alias("digest")), "dedup-digests")
    tested = Filter(digests).tested(docs.select(*_light(docs, doc_id, text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    # doc_ids may repeat or be null, so a row has a key of its own, fixed by the write; equal rows are told apart by it alone
    plain = [F.col(f"_row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    suspects = common.materialise(tested.filter("_maybe").drop("_maybe").withColumn("_tie", F.xxhash64(*plain)).withColumn("_key", F.monotonically_increasing_id()), "dedup-suspects")
    common.drop(digests)
    order = F.struct(_order().alias("first"), F.col("_tie"), F.col("_key"))
    winners = common.materialise(suspects.groupBy("digest").agg(F.max_by("_key", order).alias("_key")).select("_key"), "dedup-winners")
    stays = suspects.join(winners, "_key", "left_semi")
    return tested.filter("NOT _maybe").select("_row").unionByName(stays.select("_row")).select("_row.*")


def query(spark, sf_dir):
    return decide(common.read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM w
"""
