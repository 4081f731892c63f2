"""Mixing sources to target weights by pivotal dependent rounding (operator 1, native).

A source's target over its size is the copy rate of its documents: floor(rate) copies for certain, and the fraction is
the probability of one more. Rounding is dependent: documents are dealt to leaves of a reduction tree by (source, hash
of doc_id). In a leaf, from the largest document to the smallest, two fractional documents are a pair: mass (words times
probability) moves from one to the other, in a random direction whose odds leave both probabilities unbiased, until one
of them is 0 or 1; the other one is paired with the next document. So the words that a leaf takes stay what they should
be, but for the one document that may be left with a fraction. These residuals keep their own probability and go up to
the next level, dealt to fewer leaves, and so on; the last residual of a source is rounded by itself, so a source's words
differ from its target by less than one document. A leaf holds about FANOUT documents whatever the size of a source, so
hot sources are many leaves.

Targets: sources share SHARE of all words by weight, none above CAP times its own; excess is reshared by weight until
none is above. The sources are a table: they are numbered by a sort, and the level that the free ones reach is found by a
few sums over them.

Defined cases: null and blank texts have size 0, and take 0 words; a null source is a source of its own and comes last;
an empty table gives no rows; a very long text is a large document like any other; of documents of one size the larger
doc_id is paired first. Rows that repeat a doc_id are decided row by row: those that agree in source and size too are
numbered, and mix() deals the numbers to them. Other columns are not read, and kept by mix() whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm import common

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 7
#: Documents that a leaf of the tree is planned for.
FANOUT = 96
#: What a document is told apart by; k numbers rows that agree in the rest.
KEYS = ("doc_id", "source", "size", "k")
_ROW = (1 << 33) - 1  # bits of monotonically_increasing_id() that count within a partition


def _ordered(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """rows with their places in the order of by, from 0: the driver gets the number of rows of each sorted partition."""
    sorted_ = common.materialise(rows.orderBy(by).withColumn("_m", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_m", 33)
    offsets, total = [], 0
    for r in sorted_.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], total))
        total += r["count"]
    before = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return sorted_.join(F.broadcast(before), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit(_ROW))).drop("_m", "_part", "_before")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """sizes (source, size) to a stored row per source: source, source_size, n_docs, target."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    per = _ordered(per, F.col("source").asc_nulls_last(), "_place")
    per = common.materialise(per.withColumn("_w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_place") % len(weights)).cast("int"))), "mix-weights")
    level, known = 0.0, -1
    while True:
        over = cap * F.col("source_size") < level * F.col("_w")
        r = per.agg(F.count_if(over), F.sum("source_size"), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
        if r[0] == known or not r[1]:
            break
        known = r[0]
        level = (share * r[1] - cap * r[2]) / r[3] if r[3] else float("inf")
    return per.select("source", "source_size", "n_docs", F.least(cap * F.col("source_size"), level * F.col("_w")).alias("target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_UNIT = "struct<size:bigint,doc_id:bigint,k:bigint,p:double>"


def _walk(units: Column, seed: Column) -> Column:
    """units: array of _UNIT, in the order in which they are paired. Gives (done: array of (doc_id, size, k, up), left: _UNIT or null)."""

    def unit(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["k"].alias("k"), p.alias("p"))

    def settled(x: Column, p: Column) -> Column:
        """An array of the unit, if p is integral."""
        one = F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["k"].alias("k"), (p > 0.5).cast("int").alias("up")))
        return F.when(whole(p), one).otherwise(F.slice(one, 1, 0))

    def whole(p: Column) -> Column:
        return (p < 1e-9) | (p > 1 - 1e-9)

    def pair(acc: Column, a: Column, b: Column) -> Column:
        # up: what a can gain from b; down: what it can lose to it. The odds of the one are the length of the other
        up, down = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"]), F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
        draw = common.uniform(seed, *[x[c] for x in (a, b) for c in ("doc_id", "size", "k")])
        moved = _let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.when(draw * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))
        after = _let(moved, lambda m: F.struct((a["p"] + m / a["size"]).alias("a"), (b["p"] - m / b["size"]).alias("b")))
        return _let(after, lambda q: F.struct(
            F.concat(acc["done"], settled(a, q["a"]), settled(b, q["b"])).alias("done"),
            F.when(~whole(q["a"]), unit(a, q["a"])).when(~whole(q["b"]), unit(b, q["b"])).alias("left"),
        ))

    start = F.struct(F.array().cast("array<struct<doc_id:bigint,size:bigint,k:bigint,up:int>>").alias("done"), F.lit(None).cast(_UNIT).alias("left"))
    return F.aggregate(units, start, lambda acc, x: F.when(acc["left"].isNull(), F.struct(acc["done"].alias("done"), unit(x, x["p"]).alias("left"))).otherwise(pair(acc, acc["left"], x)))


def decide(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """sizes (doc_id, source, size): stored rows. A row per row: doc_id, source, size, k, source_size, target, copies, taken."""
    per = targets(sizes, share, cap, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a rate within rounding of a whole number is one
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    per = common.materialise(per.withColumn("_rate", near).withColumn("_base", F.floor("_rate").cast("int")).withColumn("_p", F.col("_rate") - F.floor("_rate")), "mix-rates")
    longest = per.agg(F.max("n_docs")).first()[0] or 0
    rows = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    joined = rows.join(per, rows["source"].eqNullSafe(per["source"])).drop(per["source"])
    joined = common.materialise(joined.select(*KEYS, "n_docs", F.col("_p").alias("p")), "mix-rows")
    settled = joined.filter("p = 0 OR size = 0").select(*KEYS, F.lit(0).alias("up"))
    open_ = joined.filter("p > 0 AND size > 0")
    done, level = [settled], 0
    while True:
        leaves = F.greatest(F.ceil(F.col("n_docs") / float(FANOUT) ** (level + 1)), F.lit(1))
        leaf = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size", "k"), leaves)
        units = F.sort_array(F.collect_list(F.struct("size", "doc_id", "k", "p")), asc=False)
        walked = open_.groupBy("source", leaf.alias("_leaf")).agg(_walk(units, F.lit(seed)).alias("o"), F.first("n_docs").alias("n_docs"))
        walked = common.materialise(walked.select("source", "n_docs", "o.done", "o.left"), f"mix-level{level}")
        done.append(walked.select("source", F.explode("done").alias("d")).select("d.doc_id", "source", "d.size", "d.k", "d.up"))
        open_ = walked.filter("left IS NOT NULL").select("left.doc_id", "source", "left.size", "left.k", "n_docs", "left.p")
        if longest <= FANOUT ** (level + 1):
            break
        level += 1
    done.append(open_.select(*KEYS, (common.uniform(seed, F.lit(-1), *[F.col(c) for c in KEYS]) < F.col("p")).cast("int").alias("up")))
    out = functools.reduce(DataFrame.unionByName, done)
    info = per.select(F.col("source").alias("_source"), "source_size", "target", "_base")
    out = out.join(info, out["source"].eqNullSafe(info["_source"]))
    copies = F.when(F.col("size") > 0, F.col("_base") + F.col("up")).otherwise(F.lit(0))
    return out.select(*KEYS, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _sizes(docs: DataFrame) -> DataFrame:
    return common.materialise(docs.select(F.col("doc_id").cast("long"), "source", common.word_count(F.col("text")).alias("size")), "mix-sizes")


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """a's _keys equal b's keys, nulls too."""
    return functools.reduce(Column.__and__, [a[f"_{c}"].eqNullSafe(b[c]) for c in keys])


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    taken = common.materialise(decide(_sizes(docs), share, cap, weights, seed).select(*KEYS, "copies"), "mix-decided")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("source").alias("_source"), common.word_count(F.col("text")).alias("_size"), row)
    again = taken.filter("k = 2").select("doc_id", "source", "size")
    if again.isEmpty():
        numbered = rows.withColumn("_k", F.lit(1).cast("long"))
    else:
        # rows that agree are numbered within partitions, and these by how many there are before: no window holds more than a task's rows
        some = common.materialise(rows.join(again, _same(rows, again, KEYS[:3]), "left_semi").withColumn("_m", F.monotonically_increasing_id()), "mix-repeated")
        some = some.withColumn("_part", F.shiftright("_m", 33))
        names = [f"_{c}" for c in KEYS[:3]]
        counts = some.groupBy(*names, "_part").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select(*[F.col(c).alias(c[1:]) for c in [*names, "_part"]], F.coalesce(before, F.lit(0)).alias("_before"))
        within = some.withColumn("_at", F.row_number().over(Window.partitionBy(*names, "_part").orderBy("_m")))
        placed = within.join(counts, _same(within, counts, (*KEYS[:3], "part"))).select(*names, "_row", (F.col("_before") + F.col("_at")).alias("_k"))
        numbered = rows.join(again, _same(rows, again, KEYS[:3]), "left_anti").withColumn("_k", F.lit(1).cast("long")).unionByName(placed)
    wanted = taken.filter("copies > 0")
    often = numbered.join(wanted, _same(numbered, wanted, KEYS)).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return often.select("_row.*")


def query(spark, sf_dir):
    return decide(_sizes(common.read_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "copies")
