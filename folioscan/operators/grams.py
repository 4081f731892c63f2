"""Joins of many short strings with many others by what they share: containment, and similarity of byte bigrams.

Both are equi-joins of keys, so that neither side is held against every row of the other, and neither goes through the
driver: a hot key is split by the adaptive skew join.

Containment. Strings to search in offer their grams, at most as many as they have letters. A string to find asks by one gram,
its rarest among what is offered; what shares it is verified. Short ones ask by themselves.

Similarity. Sets of bigrams are ordered, the rarest first. Two sets that are similar enough share one of the first few, have
sizes that are near, and have enough left after the bigram at which they meet; only pairs that pass all three are compared.

Defined cases: null strings find nothing and are found by nothing, nor do empty ones; rows that repeat are answered one by one
(containment) or once for each pair of ids (similarity); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import spread

#: Letters of a gram.
GRAM = 4
#: Rows, and letters of strings to find, up to which a side is sent to all tasks.
FEW = 1 << 17
#: Letters up to which a string is repeated for each of its grams.
SHORT = 1 << 9


def letters(c: Column, n: int) -> Column:
    """Distinct runs of n letters. The text is taken apart once, as finding a letter's place takes as long as the text before it."""
    runs = T.let(F.split(c, ""), lambda signs: F.transform(F.slice(signs, F.lit(1), F.size(signs) - n + 1), lambda x, i: F.concat(x, *[F.get(signs, i + k) for k in range(1, n)])))
    return F.when(F.length(c) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def by_shuffle(rows: DataFrame) -> DataFrame:
    """rows as a side of a join that is never broadcast: a table of the driver's memory, where it grows with the input."""
    return rows.hint("merge")


def beside(rows: DataFrame) -> DataFrame:
    """rows, which are short and stored, as a side of a join: sent to all tasks up to FEW of them, else shuffled."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else by_shuffle(rows)


def containment(needles: DataFrame, needle: str, hays: DataFrame, hay: str, scope: tuple[str, str] | None = None) -> DataFrame:
    """The pairs of rows for which hay contains needle, with the columns of both sides (which must differ).

    scope: a column of each side that has to be equal as well; it then is part of the key.
    """
    ask, offer = (F.concat(F.coalesce(F.col(s), F.lit("")), F.lit("\0")) if s else F.lit("") for s in scope or (None, None))
    # what is longer than all that is searched can't be found; what moves of the others is their digest
    longest = hays.agg(F.max(F.length(hay))).first()[0] or 0
    asked = needles.filter((F.col(needle) != "") & (F.length(needle) <= longest)).withColumns({"_n": F.least(F.length(needle), F.lit(GRAM)), "_key": F.unhex(F.md5(F.concat(ask, needle).cast("binary")))})
    sizes = sorted(r["_n"] for r in asked.select("_n").distinct().collect()) or [GRAM]  # GRAM numbers at most
    own = F.transform(F.coalesce(*(F.when(F.col("_n") == n, letters(F.col(needle), n)) for n in sizes)), lambda g: F.concat(ask, g))
    wanted = asked.select("_key", F.explode(own).alias("_gram")).distinct()
    # what moves of a string to search in is its hash; strings that share one are told apart by the verification
    held = hays.filter(F.col(hay) != "").withColumn("_h", F.xxhash64(offer, hay))
    every = F.concat(*[letters(F.col(hay), n) for n in sizes])
    offered = held.select("_h", F.explode(F.transform(every, lambda g: F.concat(offer, g))).alias("_gram"))
    offered = offered.join(by_shuffle(wanted.select("_gram").distinct()), "_gram", "left_semi")
    # a hash has each of its grams once unless hays repeat, and both are read twice
    offered = spread.kept(offered.distinct())
    # the rarest gram of each string that is asked for; one with a gram that nothing offers has no pair
    often = offered.groupBy("_gram").agg(F.count("*").alias("_df"))
    rarest = wanted.join(by_shuffle(often), "_gram", "left").groupBy("_key").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_gram")).alias("_r"))
    keyed = asked.join(by_shuffle(rarest.filter("_r.df > 0").select("_key", F.col("_r._gram").alias("_gram"))), "_key").drop("_key", "_n")
    return keyed.join(by_shuffle(offered), "_gram").drop("_gram").join(by_shuffle(held), "_h").drop("_h").filter(F.contains(F.col(hay), F.col(needle)))


def few_in_many(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """containment() that moves no string to search in, where those to find have FEW letters in all; else containment() itself.

    Their grams are sent to all tasks, so that of the others' grams only those remain that are asked for. hays are read several
    times; those above SHORT letters are left to containment(), as a row here is as long as its string.
    """
    asked = needles.filter(F.col(needle) != "")
    if (asked.agg(F.sum(F.length(needle).cast("bigint"))).first()[0] or 0) > FEW:
        return containment(needles, needle, hays, hay)
    long_ = hays.filter(F.length(hay) > SHORT)
    if not long_.isEmpty():
        return few_in_many(needles, needle, hays.filter(F.length(hay) <= SHORT), hay).unionByName(containment(needles, needle, long_, hay))
    size = F.least(F.length(needle), F.lit(GRAM))
    sizes = sorted(r[0] for r in asked.select(size).distinct().collect()) or [GRAM]  # GRAM numbers at most
    own = F.coalesce(*(F.when(size == n, letters(F.col(needle), n)) for n in sizes))
    wanted = asked.select(needle, F.explode(own).alias("_gram")).distinct()
    every = F.concat(*[letters(F.col(hay), n) for n in sizes])
    offered = hays.filter(F.col(hay) != "").select("*", F.explode(every).alias("_gram"))
    offered = spread.kept(offered.join(F.broadcast(wanted.select("_gram").distinct()), "_gram", "left_semi"))
    often = offered.groupBy("_gram").agg(F.count("*").alias("_df"))
    rarest = wanted.join(by_shuffle(often), "_gram", "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_gram")).alias("_r"))
    keyed = asked.join(by_shuffle(rarest.filter("_r.df > 0").select(needle, F.col("_r._gram").alias("_gram"))), needle)
    return offered.join(F.broadcast(keyed), "_gram").drop("_gram").filter(F.contains(F.col(hay), F.col(needle)))


def _ranked(rows: DataFrame, rank: DataFrame) -> DataFrame:
    """rows (id, grams) to (id, n, grams): grams by their rank, the rarest first."""
    # explode_outer: a filter of the rows with bigrams would compute their texts once more, before they are dealt; nulls meet nothing
    each = rows.select("id", F.explode_outer("grams").alias("gram")).join(by_shuffle(rank), "gram")
    return each.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left and right (id, s) to (a, b, na, nb, ga, gb): the pairs that the bounds leave, with their ordered bigrams.

    A string's bigrams are at most as many as its bytes, so a row's arrays are as long as the string.
    """
    sides = [side.filter("id IS NOT NULL AND s IS NOT NULL").select("id", T.byte_bigrams(F.col("s")).alias("grams")) for side in (left, right)]
    rank = sides[0].unionByName(sides[1]).select(F.explode_outer("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    one, two = (_ranked(side, rank) for side in sides)
    # of n bigrams, n - ceil(least * n) + 1 can stand before the first that is shared
    first = lambda: F.slice("grams", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    keyed = [side.select("id", "n", "grams", F.posexplode(first()).alias("at", "g")).select("id", "n", "grams", "at", F.col("g.gram").alias("gram")) for side in (one, two)]
    a = keyed[0].select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"), F.col("at").alias("pa"), "gram")
    b = keyed[1].select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"), F.col("at").alias("pb"), "gram")
    near = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    # two sets that meet at several bigrams are one pair, and one that is similar enough passes at the first of them
    return a.join(by_shuffle(b), "gram").filter(near).dropDuplicates(["a", "b"]).select("a", "b", "na", "nb", "ga", "gb")


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left and right (id, s) to the pairs (a, b, score) whose bigrams have a Jaccard similarity of least or more."""
    if not 0 < least <= 1:
        raise ValueError("a similarity above 0, of 1 at most")
    both = F.size(F.array_intersect("ga", "gb"))
    score = both / (F.col("na") + F.col("nb") - both).cast("double")
    return candidates(left, right, least).select("a", "b", score.alias("score")).filter(F.col("score") >= least - 1e-12)
