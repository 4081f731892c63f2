"""Fuzzy title scores, top-k, identifier lookup, and resolving a query across sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as T
from folioscan.operators import grams, spread

#: Least score of a subsequence, of an alias that holds the query, of a contributor; and what a numeric match adds.
SUBSEQUENCE, ALIAS, CONTRIBUTOR, NUMERIC = 0.85, 0.95, 0.93, 0.05
#: What a preferred source adds, and the scores of a direct identifier and of a crosswalk.
PREFERRED, DIRECT, CROSSWALK, CROSSWALK_ID, LEAST = 0.02, 1.20, 1.05, 0.05, 0.1
CONTRIBUTORS = ("author", "editor", "translator", "publisher")
# The keys that count for titles in Pali.
PALI_KEYS = ("alias", "alias_prefix", "nikaya", "book", "title", "subhead", "subsubhead", "chapter", "headsPreview")
# Names of works, and their identifiers and titles in each corpus.
CROSSWALK_WORKS = {
    "heart-sutra": (
        ("般若心経", "般若心經", "般若波羅蜜多心経", "般若波羅蜜多心經", "T0251", "T08n0251", "prajJApAramitAhRdayasUtra", "sa_prajJApAramitAhRdayasUtra", "Heart Sutra"),
        {"cbeta": ("T0251", "般若波羅蜜多心經"), "gretil": ("prajJApAramitAhRdayasUtra", "Prajñāpāramitāhṛdayasūtra")},
    ),
    "diamond-sutra": (
        ("金剛経", "金剛經", "金剛般若経", "金剛般若經", "金剛般若波羅蜜経", "金剛般若波羅蜜經", "T0235", "T08n0235", "vajracchedikA", "sa_vajracchedikA-prajJApAramitA", "Diamond Sutra"),
        {"cbeta": ("T0235", "金剛般若波羅蜜經"), "gretil": ("vajracchedikA", "Vajracchedikā")},
    ),
    "lotus-sutra": (
        ("法華経", "法華經", "妙法蓮華経", "妙法蓮華經", "T0262", "T09n0262", "saddharmapuNDarIka", "sa_saddharmapuNDarIka", "Lotus Sutra"),
        {"cbeta": ("T0262", "妙法蓮華經"), "gretil": ("saddharmapuNDarIka", "Saddharmapuṇḍarīka")},
    ),
    "lankavatara-sutra": (
        ("楞伽経", "楞伽經", "楞伽阿跋多羅宝経", "楞伽阿跋多羅寶經", "T0670", "T16n0670", "laGkAvatArasUtra", "saddharmalaGkAvatArasUtra"),
        {"cbeta": ("T0670", "楞伽阿跋多羅寶經"), "gretil": ("laGkAvatArasUtra", "Laṅkāvatārasūtra")},
    ),
}


def haystack(title: Column, identifier: Column, meta: Column | None = None, keys: tuple[str, ...] | None = None) -> Column:
    """title, id and the values of meta in the order of its keys (or those of keys, in theirs); the separators are always there."""
    if meta is None:
        values = F.lit("")
    elif keys:
        values = F.concat_ws(" ", *[meta[k] for k in keys])
    else:
        values = F.array_join(F.transform(F.array_sort(F.map_keys(meta)), lambda k: meta[k]), " ")
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(identifier, F.lit("")), F.coalesce(values, F.lit("")))


def with_hay(entries: DataFrame, hay: Column, folded: bool = False) -> DataFrame:
    """entries with hay_norm and hay_ws (folded: and hay_fold): to be stored with a catalogue, as queries read nothing else."""
    out = entries.withColumn("hay_norm", T.normalised(hay)).withColumn("hay_ws", T.normalised_spaces(hay))
    return out.withColumn("hay_fold", T.normalised(hay, variants=False)) if folded else out


def base_score(hay_norm: Column, hay_ws: Column, query: str, folded: Column | None = None) -> Column:
    """1 if the query is contained, else the better Jaccard; a subsequence either way scores SUBSEQUENCE at least.

    folded: the Pali and Sanskrit fold of the same text, normalised() without variants; it is compared as well.
    """
    q, spaced = T.python_normalised(query), T.python_normalised_spaces(query)
    tokens = F.array(*[F.lit(t) for t in dict.fromkeys(spaced.split())]) if spaced else F.array().cast("array<string>")
    near = F.greatest(T.byte_jaccard(hay_norm, F.lit(q)), T.token_jaccard(T.token_set(hay_ws), tokens))
    ordered = T.contains_in_order(hay_norm, q) | T.is_subsequence(F.lit(q), hay_norm)
    if folded is not None:
        plain = T.python_normalised(query, variants=False)
        near = F.greatest(near, T.byte_jaccard(folded, F.lit(plain)))
        ordered = ordered | T.contains_in_order(folded, plain)
    return _in_order(F.when(hay_norm.contains(q), F.lit(1.0)).otherwise(near), ordered)


def _in_order(score: Column, ordered: Column) -> Column:
    """score, of SUBSEQUENCE at least where one text is a subsequence of the other."""
    return T.let(F.struct(score.alias("s"), ordered.alias("o")), lambda x: F.when((x["s"] < 0.95) & x["o"], F.greatest(x["s"], F.lit(SUBSEQUENCE))).otherwise(x["s"]))


def match_score(hay_norm: Column, hay_ws: Column, query: str, alias: Column | None = None, folded: Column | None = None) -> Column:
    score, spaced = base_score(hay_norm, hay_ws, query, folded), T.python_normalised_spaces(query)
    if alias is not None:
        flat = F.replace(T.normalised_spaces(F.coalesce(alias, F.lit(""))), F.lit(" "), F.lit(""))
        found = flat.contains(spaced.replace(" ", ""))
        if folded is not None:
            alias_fold = T.normalised(F.coalesce(alias, F.lit("")), variants=False)
            found = found | ((alias_fold != "") & alias_fold.contains(T.python_normalised(query, variants=False)))
        score = T.let(F.struct(score.alias("s"), ((flat != "") & found).alias("f")), lambda x: F.when(x["f"], F.greatest(x["s"], F.lit(ALIAS))).otherwise(x["s"]))
    if re.search("[0-9]", query) and spaced:
        score = T.let(F.struct(score.alias("s"), hay_ws.contains(spaced).alias("f")), lambda x: F.when(x["f"], F.least(x["s"] + NUMERIC, F.lit(1.0))).otherwise(x["s"]))
    return score


def title_score(hay_norm: Column, hay_ws: Column, query: str) -> Column:
    """The score of a plain title, which need not contain the query to be near."""
    q, spaced = T.python_normalised(query), T.python_normalised_spaces(query)
    tokens = F.array(*[F.lit(t) for t in dict.fromkeys(spaced.split())]) if spaced else F.array().cast("array<string>")
    score = F.greatest(T.byte_jaccard(hay_norm, F.lit(q)), T.token_jaccard(T.token_set(hay_ws), tokens))
    return _in_order(score, T.contains_in_order(hay_norm, q) | T.is_subsequence(F.lit(q), hay_norm))


def scored_titles(rows: DataFrame, title: str, query: str, score: str = "score") -> DataFrame:
    """rows with the score of their titles. The normal forms are columns of their own: Python runs once for each row, before any lambda."""
    hay = with_hay(rows, F.coalesce(F.col(title), F.lit("")))
    return hay.withColumn(score, F.round(title_score(F.col("hay_norm"), F.col("hay_ws"), query), 6)).drop("hay_norm", "hay_ws")


def contributor_boost(score: Column, contributors: list[Column], query: str) -> Column:
    q = T.python_normalised(query)
    for c in contributors:
        n = T.normalised(F.coalesce(c, F.lit("")))
        score = T.let(F.struct(score.alias("s"), ((n != "") & (n.contains(q) | F.contains(F.lit(q), n))).alias("f")), lambda x: F.when(x["f"], F.greatest(x["s"], F.lit(CONTRIBUTOR))).otherwise(x["s"]))
    return score


def canon_bias(score: Column, canon: Column, identifier: Column, preferred: str = "T") -> Column:
    more = F.when(canon == preferred, 0.02).when(identifier.startswith(preferred), 0.01)
    return T.let(F.struct(score.alias("s"), more.alias("m")), lambda x: F.when(x["m"].isNotNull(), F.least(x["s"] + x["m"], F.lit(1.2))).otherwise(x["s"]))


def top_k(scored: DataFrame, k: int, *ties: str, score: str = "score") -> DataFrame:
    """The best k by score, then by ties; 0 gives none."""
    return scored.orderBy(F.desc(score), *ties).limit(k)


def title_search(entries: DataFrame, query: str, limit: int = 10, alias: str | None = None, contributors: tuple[str, ...] = (), folded: bool = False, canon: str | None = None) -> DataFrame:
    """entries (id, hay_norm, hay_ws, ...) with score, the best first.

    folded: Pali and Sanskrit titles, compared by hay_fold as well; canon: the column of canons, of which one is preferred.
    """
    score = match_score(F.col("hay_norm"), F.col("hay_ws"), query, F.col(alias) if alias else None, F.col("hay_fold") if folded else None)
    score = canon_bias(score, F.col(canon), F.col("id")) if canon else score
    score = contributor_boost(score, [F.col(c) for c in contributors], query) if contributors else score
    return top_k(entries.withColumn("score", F.round(score, 6)), limit, "id")


def printed(found: DataFrame, as_json: bool = False, meta: str | None = None) -> DataFrame:
    """A title search's few rows (id, title, path, score) as one text: numbered lines, or JSON with their count."""
    shown = ["id", "title", "path", "score", *([meta] if meta else [])]
    rows = found.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("least"), F.col("id").alias("tie"), F.struct(*shown).alias("row")))).alias("rows"))
    every = F.transform("rows", lambda r: r["row"])
    if as_json:
        return rows.select(F.to_json(F.struct(F.size("rows").alias("count"), every.alias("results"))).alias("text"))
    lines = F.transform(every, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["id"], F.lit("  "), F.coalesce(r["title"], F.lit(""))))
    return rows.select(F.array_join(lines, "\n").alias("text"))


def _given(source: str, identifier: Column, title: Column, rank_score: Column, by: str) -> Column:
    return F.struct(F.lit(source).alias("source"), identifier.alias("id"), title.alias("title"), rank_score.alias("rank_score"), F.lit(by).alias("by"))


def _preference(source: str, preferred: str | None) -> float:
    return PREFERRED if source == preferred else 0.0


def direct_candidates(query: Column, sources: tuple[str, ...], preferred: str | None = None) -> Column:
    """array<struct<source, id, title, rank_score, by>> of a query that is an identifier itself, in any case, blanks left out."""
    flat, none = F.regexp_replace(query, r"(?U)\s", ""), F.lit(None).cast("string")
    up, out = F.upper(F.regexp_replace(query, r"(?U)\s", "")), []
    number = lambda digits: F.when(digits.try_cast("bigint") < 1 << 32, digits.try_cast("bigint").cast("string"))
    give = lambda source, identifier: out.append(_given(source, identifier, none, F.lit(round(DIRECT + _preference(source, preferred), 6)), "direct-id"))
    if "cbeta" in sources:
        n = number(F.regexp_extract(up, r"\AT([0-9]+)", 1))
        give("cbeta", F.concat(F.lit("T"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)))
    if "tipitaka" in sources:
        collection = F.nullif(F.regexp_extract(up, r"\A(DN|MN|SN|AN|KN)", 1), F.lit(""))
        give("tipitaka", F.concat(collection, number(F.regexp_replace(F.substring(up, 3, 1 << 30), "[^0-9]", ""))))
        give("tipitaka", F.when(flat.contains(".mul"), flat))
    return F.filter(F.array(*out), lambda x: x["id"].isNotNull()) if out else F.array().cast("array<struct<source:string,id:string,title:string,rank_score:double,by:string>>")


def crosswalk_candidates(normal: Column, sources: tuple[str, ...], preferred: str | None = None) -> Column:
    """array<struct<source, id, title, rank_score, by>> of the works that a normalised query names; an identifier itself counts more."""
    none = F.array().cast("array<struct<source:string,id:string,title:string,rank_score:double,by:string>>")

    def held(normal: Column) -> Column:
        out = []
        for names, works in CROSSWALK_WORKS.values():
            known = [T.python_normalised(n) for n in names]
            hit = normal.isin(known) | (F.octet_length(normal) >= 6) & F.exists(F.array(*[F.lit(n) for n in known]), lambda n: F.contains(n, normal) | F.contains(normal, n))
            given = []
            for source in ("cbeta", "tipitaka", "gretil"):
                if source in sources and source in works:
                    identifier, title = works[source]
                    score = CROSSWALK + _preference(source, preferred)
                    exact = normal == F.lit(T.python_normalised(identifier))
                    rank_score = F.when(exact, round(score + CROSSWALK_ID, 6)).otherwise(round(score, 6))
                    given.append(_given(source, F.lit(identifier), F.lit(title), rank_score, "crosswalk"))
            if given:
                # whether a work is named is found out once for all its sources
                out.append(F.when((normal != "") & hit, F.array(*given)).otherwise(none))
        return F.concat(*out) if out else none

    return T.let(normal, held)


def given_candidates(queries: DataFrame, query: str, sources: tuple[str, ...] = ("cbeta", "tipitaka", "gretil"), preferred: str | None = None, limit: int = 10) -> DataFrame:
    """queries with candidates: identifiers first, then the crosswalk's works, a (source, id) once, the best first; and direct:
    whether the query is an identifier, for which titles aren't searched. Null queries have none. Nothing is shuffled."""
    out = queries.withColumns({"_direct": direct_candidates(F.coalesce(query, F.lit("")), sources, preferred), "_normal": T.normalised(F.coalesce(query, F.lit("")))})
    both = F.concat("_direct", crosswalk_candidates(F.col("_normal"), sources, preferred))
    # the rank decides, then the place; of a (source, id) the first in that order stays
    keyed = F.array_sort(F.transform(both, lambda x, i: F.struct((-x["rank_score"]).alias("least"), i.alias("place"), x.alias("x"))))
    first = T.let(F.transform(keyed, lambda k: k["x"]), lambda ordered: F.filter(ordered, lambda x, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda y: (y["source"] == x["source"]) & (y["id"] == x["id"]))))
    return out.withColumns({"candidates": F.slice(first, 1, max(1, limit)), "direct": F.size("_direct") > 0}).drop("_direct", "_normal")


def resolve_query(spark: SparkSession, query: str, per_source: list[DataFrame], sources: tuple[str, ...] = ("cbeta", "tipitaka", "gretil"), limit: int = 10, per_source_limit: int = 5, least: float = LEAST, preferred: str | None = None) -> DataFrame:
    """One query to its ranked candidates (source, id, title, rank_score): identifiers and works of the crosswalk, then, unless it
    is an identifier, the titles of per_source (source, id, title, score)."""
    asked = given_candidates(spark.createDataFrame([(query,)], "q string"), "q", sources, preferred, limit=1 << 20)
    found = asked.first()  # one row of at most a dozen candidates
    rows = [(c["source"], c["id"], c["title"], c["rank_score"], i - len(found["candidates"])) for i, c in enumerate(found["candidates"])]
    given = spark.createDataFrame(rows, "source string, id string, title string, rank_score double, seq int")
    if found["direct"] or not per_source:
        return given.orderBy(F.desc("rank_score"), "seq").limit(max(1, limit)).drop("seq")
    titles = resolve(spark, per_source, 1 << 20, per_source_limit, least, preferred).select("source", "id", "title", "rank_score", "seq")
    first = F.row_number().over(Window.partitionBy("source", "id").orderBy(F.desc("rank_score"), "seq"))
    return given.unionByName(titles).withColumn("_n", first).filter("_n = 1").orderBy(F.desc("rank_score"), "seq", "id").limit(max(1, limit)).drop("_n", "seq")


def _named(asked: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked (nq) and names (key, na), without repeats: (nq, _set) of those that name something, and the distinct (_set, key).

    What texts of one set hold are the same names, so the keys of these are found once for all of them. A set is known by the
    number of its names and the sums, bit by bit, of 120 bits of their digests; a pair of texts must not come twice for that.
    """
    half = lambda at: F.conv(F.substring(F.md5("na"), at, 15), 16, 10).cast("bigint")
    # a name of many keys is searched once
    texts = spread.kept(names.select("na").distinct().withColumns({"_a": half(1), "_b": half(16)}))
    long_ = asked.filter(F.octet_length("nq") >= 6)
    columns = "nq", "na", "_a", "_b"
    met = asked.filter(F.octet_length("nq") < 6).join(grams.by_shuffle(texts), F.col("nq") == F.col("na")).select(*columns)
    met = met.unionByName(grams.few_in_many(texts, "na", long_, "nq").select(*columns))
    met = met.unionByName(grams.containment(long_, "nq", texts, "na").filter("nq <> na").select(*columns))
    met = spread.kept(met)
    summed = met.groupBy("nq").agg(F.count("*").alias("n"), F.bit_xor("_a").alias("a"), F.bit_xor("_b").alias("b"))
    sets = spread.kept(summed.select("nq", F.struct("n", "a", "b").alias("_set")))
    # the names of a set are those of one of its texts
    first = spread.kept(sets.groupBy("_set").agg(F.min("nq").alias("nq")))
    held = met.select("nq", "na").join(grams.beside(first), "nq").select("_set", "na")
    return sets, spread.kept(held.join(grams.by_shuffle(names), "na").select("_set", "key").distinct())


def _names(aliases: DataFrame) -> DataFrame:
    return spread.kept(aliases.select("key", "na").filter("na <> ''").distinct())


def crosswalk(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """queries (..., nq) and aliases (key, na), both normalised, with the keys of the names that are equal, or hold one another
    where the query has 6 bytes. Names without letters and numbers name nothing. Rows that repeat are answered one by one.

    Neither table has a bound: short texts are a join, and the others meet by a gram of the shorter one (grams.few_in_many(),
    grams.containment()). Keys are put to sets of names, of which there are as many as there are different answers.
    """
    columns = queries.columns
    rows = spread.kept(queries.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns])).select("_row", "nq").filter("nq IS NOT NULL"))
    sets, keys = _named(spread.kept(rows.select("nq").distinct()), _names(aliases))
    return rows.join(grams.by_shuffle(sets), "nq").join(grams.beside(keys), "_set").select("_row.*", "key")


def crosswalk_distinct(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """queries (id, nq) and aliases (key, na) to the distinct (id, key) of crosswalk(), whose rows aren't shuffled for that: only
    ids with several texts that hold different names are made distinct after their keys are known."""
    rows = spread.kept(queries.select("id", "nq").filter("nq IS NOT NULL").distinct())
    sets, keys = _named(spread.kept(rows.select("nq").distinct()), _names(aliases))
    asked = spread.kept(rows.join(grams.by_shuffle(sets), "nq").select("id", "_set"))
    ids = spread.kept(asked.groupBy("id").agg(F.min("_set").alias("_set"), F.max("_set").alias("_last")))
    put = grams.beside(keys)
    one = ids.filter("_set = _last").select("id", "_set").join(put, "_set").select("id", "key")
    several = ids.filter("_set <> _last").select(F.col("id").alias("_id"))
    more = asked.join(grams.by_shuffle(several), F.col("id").eqNullSafe(F.col("_id"))).select("id", "_set").distinct()
    return one.unionByName(more.join(put, "_set").select("id", "key").distinct())


def resolve_batch(queries: DataFrame, titles: DataFrame, least: float, k: int = 10) -> DataFrame:
    """queries (query_id, text) and titles (id, title) to the k titles of each query with a byte similarity of least or more:
    query_id, id, score, place. Normal forms that are equal are compared once, and ranked once: a title stands for its k first ids,
    and what many queries ask for alike moves as the k best of one text, so neither side's repeats multiply the other's."""
    q = spread.evenly(queries.select("query_id", "text")).select("query_id", T.normalised(F.coalesce("text", F.lit(""))).alias("_q"))
    t = spread.evenly(titles.select("id", "title")).select("id", T.normalised(F.coalesce("title", F.lit(""))).alias("_t"))
    pairs = grams.similar(q.select(F.col("_q").alias("id"), F.col("_q").alias("s")).distinct(), t.select(F.col("_t").alias("id"), F.col("_t").alias("s")).distinct(), least)
    placed = lambda rows, by, *order: rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)
    best = F.desc("score"), "id"
    first = placed(t, "_t", "id").drop("place")
    ranked = placed(pairs.select(F.col("a").alias("_q"), F.col("b").alias("_t"), F.round("score", 6).alias("score")).join(first, "_t"), "_q", *best).select("_q", "id", "score")
    return placed(q.join(ranked, "_q").select("query_id", "id", "score"), "query_id", *best)


def resolve(spark: SparkSession, per_source: list[DataFrame], limit: int = 10, per_source_limit: int = 5, least: float = LEAST, preferred: str | None = None) -> DataFrame:
    """Each source's candidates (source, id, title, score) to one ranked list, in which a (source, id) occurs once."""
    merged = None
    for seq, c in enumerate(per_source):
        best = top_k(c.filter(F.col("score") >= least), per_source_limit, "id").withColumn("seq", F.lit(seq))
        merged = best if merged is None else merged.unionByName(best)
    rank = F.col("score") + F.when(F.col("source") == F.lit(preferred), PREFERRED).otherwise(F.lit(0.0))
    merged = merged.withColumn("rank_score", F.round(rank, 6))
    first = F.row_number().over(Window.partitionBy("source", "id").orderBy(F.desc("rank_score"), "seq"))
    return merged.withColumn("_n", first).filter("_n = 1").orderBy(F.desc("rank_score"), "seq", "id").limit(max(1, limit)).drop("_n")


def lookup(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (wanted_id) to the path that fits best: equal id, equal id in any case, with a known prefix, then as the start of one; of several the first path.

    Each entry offers a key to each rule; the best of a key is found before the one join, so ids that share a stem move as one row.
    """
    rule = lambda n, key: F.struct(F.lit(n).alias("prio"), key.alias("key"))
    i, w = F.col("id"), F.col("wanted_id")
    offers = F.array(rule(0, i), rule(1, F.lower(i)), rule(2, i), rule(3, F.lower(F.regexp_replace(i, r"[0-9]+$", ""))))
    asks = F.array(rule(0, w), rule(1, F.lower(w)), rule(2, F.concat(F.lit("sa_"), w)), rule(3, F.lower(w)))
    trailing = F.coalesce(F.regexp_extract(i, "([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    best = catalog.select(F.inline(offers), trailing.alias("trailing"), "path").groupBy("prio", "key").agg(F.min(F.struct("trailing", "path")).alias("best"))
    asked = wanted.select("wanted_id", F.inline(asks))
    return asked.join(best, ["prio", "key"]).groupBy("wanted_id").agg(F.min_by("best.path", "prio").alias("path"))


def pick_by_tier(docs: DataFrame, query: str, body: str, title: str, position: str) -> DataFrame:
    """docs with tier (0: body holds the query, 1: title does, 2: neither), in normal forms, in the order in which they are picked.

    A query without letters and numbers is held by nothing: the nearest title is picked.
    """
    q = T.python_normalised(query)
    held = lambda c: T.normalised(F.coalesce(F.col(c), F.lit(""))).contains(q) if q else F.lit(False)
    scored = scored_titles(docs.withColumn("tier", F.when(held(body), 0).when(held(title), 1).otherwise(2)), title, query, "title_score")
    return scored.orderBy("tier", F.when(F.col("tier") == 2, -F.col("title_score")).otherwise(F.lit(0.0)), position)


def pick_by_title(docs: DataFrame, query: str, title: str, position: str) -> DataFrame:
    """The one document whose title is nearest, the first of equals, with title_score: what a search fetches on its own."""
    return scored_titles(docs, title, query, "title_score").orderBy(F.desc("title_score"), position).limit(1)


def probe(candidates: DataFrame, pages: DataFrame, query: str, most: int = 5) -> DataFrame:
    """candidates (url, pos) and stored pages (url, text): of the first few, the first whose text holds the query, else the first with text."""
    first = candidates.orderBy("pos").limit(most).join(pages, "url")
    with_text = first.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    return with_text.orderBy(F.when(F.col("text").contains(query), 0).otherwise(1), "pos").limit(1)


def distinct_paged(rows: DataFrame, key: str, position: str, limit: int, offset: int = 0) -> DataFrame:
    """The first row of each key, in order of position, from offset on."""
    first = rows.groupBy(key).agg(F.min(position).alias(position))
    return first.orderBy(position).offset(offset).limit(limit)


def merge_by_url(backends: list[DataFrame], limit: int, by_score: bool = False) -> DataFrame:
    """Hits (url, title, score) of several backends: a url once, in order of arrival, or the best first."""
    every = None
    for b, hits in enumerate(backends):
        hits = hits.select("url", "title", "score", F.lit(b).alias("backend"), "pos")
        every = hits if every is None else every.unionByName(hits)
    kept = every.groupBy("url").agg(F.min(F.struct("backend", "pos", "title", "score")).alias("h")).select("url", "h.*")
    order = [F.desc("score"), "backend", "pos"] if by_score else ["backend", "pos"]
    return kept.orderBy(*order).limit(limit)


def percentiles(samples: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), bins: int = 16) -> DataFrame:
    """One row: n, min, mean, max, and for each point the sample at rank round(p * (n - 1)).

    Approximate quantiles cut the values into bins * bins ranges of about as many rows each, however they are spread. Counts
    per range (a bounded table) tell which ranges hold the ranks; only those ranges' distinct values are ranked.
    """
    v = F.col(value).cast("double")
    rows = samples.select(v.alias("v")).filter("v IS NOT NULL")
    fine = [k / bins**2 for k in range(1, bins**2)]
    total = rows.agg(F.count("*").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.percentile_approx("v", fine, 8 * bins**2).alias("cuts")).first()
    n, names = total["n"], [f"p{round(100 * p)}" for p in points]
    fixed = [F.lit(n).cast("long").alias("n"), *[F.lit(total[c]).cast("double").alias(c) for c in ("min", "mean", "max")]]
    if not n:
        return samples.sparkSession.range(1).select(*fixed, *[F.lit(None).cast("double").alias(c) for c in names])
    # two levels of cuts, so that a value is compared 2 * bins times; a value belongs to the range that begins at or before it
    cuts = total["cuts"]
    coarse, inner = cuts[bins - 1 :: bins], [cuts[k * bins : k * bins + bins - 1] for k in range(bins)]
    level = lambda edges, x: F.size(F.filter(edges, lambda e: e <= x))
    outer = level(F.lit(coarse), F.col("v"))
    binned = rows.withColumn("_o", outer).withColumn("bin", F.col("_o") * bins + level(F.get(F.lit(inner), F.col("_o")), F.col("v"))).drop("_o")
    counts = sorted((r["bin"], r["count"]) for r in binned.groupBy("bin").count().collect())
    wanted, before = {}, 0
    for b, c in counts:
        for name, p in zip(names, points, strict=True):
            if before <= (rank := int(p * (n - 1) + 0.5)) < before + c:
                wanted[name] = (b, rank - before)
        before += c
    per = binned.filter(F.col("bin").isin({b for b, _ in wanted.values()})).groupBy("bin", "v").agg(F.count("*").alias("c"))
    per = per.withColumn("upto", F.sum("c").over(Window.partitionBy("bin").orderBy("v")))
    return per.agg(*fixed, *[F.min(F.when((F.col("bin") == wanted[c][0]) & (F.col("upto") > wanted[c][1]), F.col("v"))).alias(c) for c in names])
