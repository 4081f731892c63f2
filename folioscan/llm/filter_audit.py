"""Filter interaction audit (operator 13, native): what each filter of a chain removes, in every order of the chain.

Mask histogram: each document becomes five bits, one for each filter that it fails. Four of them depend on its text alone;
the fifth (E, an identical text under a smaller doc_id) comes from grouping texts, by their SHA-256, for the minimum doc_id.
A part (a lang value) is then 32 cells of counts, and everything asked about the 120 orders is a sum over cells: a step
removes the cells that have its bit and none of the bits before it.

Rows shuffle as digests, doc_ids and masks, never as texts. Copies of one text are counted before they shuffle, and so are
the rows of a cell, so neither a hot text nor a hot part lands in one task: a group's rows at its last stage are at most
as many as there are tasks times parts.

Defined cases: null text is empty (it fails A, not B, C or D); a null lang is the part '', as an empty one is; a null doc_id
is neither smaller nor larger than any other, so it never fails E, and has no labels; rows that repeat a doc_id are counted
row by row, and don't fail E by each other; a doc_id that labels has more than once is good, or toxic, if one of its rows
says so; null labels say nothing; very long texts are read whole; an empty table has no parts and gives no rows. Other
columns, also ones called like the results, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm import common

FILTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MARKS = r"[#$%&*|]"
CELLS, ORDERS = 1 << len(FILTERS), factorial(len(FILTERS))


def text_mask(text: Column) -> Column:
    """The bits of A to D: those that a text fails by itself."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, common.SPACE + "+"), lambda w: w != "")
    count = F.struct(F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("u"))
    fails = [
        lambda c: c["n"] < FEWEST_WORDS,
        lambda c: 100 * c["u"] < LEAST_DISTINCT * c["n"],
        lambda c: 100 * F.regexp_count(body, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(body),
        lambda c: body.rlike(MARKS),
    ]
    bits = lambda c: sum((F.when(f(c), 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return F.get(F.transform(F.array(count), bits), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of mask, and how many of those are labelled."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("bad"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    light = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"), text_mask(F.col(text)).alias("mask"), digest.alias("digest"))
    # rows that agree in all of these are one from here on, so the rows of a group's smallest doc_id are counted with it
    light = light.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    light = common.materialise(light, "audit-rows")
    named = light.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").na.fill(0, ["good", "bad"])
    nameless = light.filter("doc_id IS NULL").withColumns({"good": F.lit(0), "bad": F.lit(0)})
    group = ["digest", "part", "mask", "good", "bad"]
    at_least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = named.unionByName(nameless).groupBy(*group).agg(
        F.sum("n").alias("n"), at_least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    # a digest has as many rows here as there are parts and labels at most
    smallest = F.min("least.doc_id").over(Window.partitionBy("digest"))
    copies = copies.withColumn("stay", F.col("no_id") + F.when(F.col("least.doc_id") == smallest, F.col("least.n")).otherwise(0))
    bit = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    cells = copies.select("part", "good", "bad", F.explode(both).alias("c")).filter("c.n > 0")
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("bad")).alias("toxic"))


def orders(cells: DataFrame) -> DataFrame:
    """The report: a row per part, order of the filters and step, from the cells of masks()."""
    value = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
    wide = cells.groupBy("part").agg(*[F.array(*[value(c, m) for m in range(CELLS)]).alias(c) for c in ("n", "good", "toxic")])
    steps = [("".join(p), k + 1, FILTERS.index(p[k]), sum(1 << FILTERS.index(x) for x in p[:k])) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    table = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k).alias("k"), F.lit(f).alias("f"), F.lit(b).alias("b")) for o, k, f, b in steps])
    rows = wide.select("part", "n", "good", "toxic", F.explode(table).alias("s"))
    bit, before = F.expr("shiftleft(1, s.f)"), F.col("s.b")

    def total(counts: str, which: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.transform(F.col(counts), lambda x, m: F.when(which(m), x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)

    has = lambda m: m.bitwiseAND(bit) != 0
    out_before = lambda m: m.bitwiseAND(before) != 0
    # a cell of j filters is removed by each of them in 120 / j of the orders
    shares = F.array(*[F.lit(0 if not m else ORDERS // m.bit_count()).cast("long") for m in range(CELLS)])
    shapley = F.aggregate(F.transform(F.col("n"), lambda x, m: F.when(has(m), x * F.get(shares, m)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"),
        total("n", lambda m: ~out_before(m) & ~has(m)).alias("kept"), total("n", lambda m: ~out_before(m) & has(m)).alias("removed"),
        total("n", lambda m: out_before(m) & has(m)).alias("redundant"), F.get("n", bit).alias("unique_fails"),
        total("good", lambda m: ~out_before(m) & has(m)).alias("good_lost"), total("toxic", lambda m: ~out_before(m) & has(m)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def query(spark, sf_dir):
    return orders(masks(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels")))


SQL = r"""
WITH marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), f AS (
  SELECT d.part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), ran AS (
  SELECT part, good, bad, filter_order, fails, list_position(list_transform(string_split(filter_order, ''), lambda l: fails[ascii(l) - 64]), true) AS gone FROM f, o
), s AS (
  SELECT part, filter_order, unnest([1, 2, 3, 4, 5]) AS step, good, bad, fails, gone FROM ran
), r AS (
  SELECT *, substr(filter_order, step, 1) AS letter, fails[ascii(substr(filter_order, step, 1)) - 64] AS fail, list_sum(list_transform(fails, lambda b: b::INT)) AS n_fails FROM s
), g AS (
  SELECT part, filter_order, step::INT AS step, letter, count(*) FILTER (gone IS NULL OR gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (fail AND gone < step) AS redundant, count(*) FILTER (fail AND n_fails = 1) AS unique_fails,
    count(*) FILTER (gone = step AND good = 1) AS good_lost, count(*) FILTER (gone = step AND bad = 1) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""
