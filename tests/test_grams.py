import itertools
import random

from pyspark.sql import functions as F

from folioscan.operators import grams, rank


def bigrams(s):
    b = s.encode()
    return {b[i : i + 2] for i in range(len(b) - 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def made(seed, n, letters="abcé"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_containment(spark):
    needles, hays = [*made(1, 60), None, "", "abab", "x" * 50], [*made(2, 120), None, "", "x" * 49]
    a = spark.createDataFrame(list(enumerate(needles)), "i int, needle string")
    b = spark.createDataFrame(list(enumerate(hays)), "j int, hay string")
    got = sorted((r["i"], r["j"]) for r in grams.containment(a, "needle", b, "hay").collect())
    assert got == sorted((i, j) for (i, x), (j, y) in itertools.product(enumerate(needles), enumerate(hays)) if x and y and x in y)
    same = grams.containment(a.withColumn("s", F.col("i") % 3), "needle", b.withColumn("t", F.col("j") % 3), "hay", ("s", "t"))
    assert sorted((r["i"], r["j"]) for r in same.collect()) == [(i, j) for i, j in got if i % 3 == j % 3]
    assert grams.containment(a.limit(0), "needle", b, "hay").count() == 0 and grams.containment(a, "needle", b.limit(0), "hay").count() == 0


def test_a_string_offers_as_many_grams_as_it_has_letters(spark):
    rows = spark.createDataFrame([("abcdefgh" * 20,), ("abc",), ("",)], "s string")
    assert [r[0] for r in rows.select(F.size(grams.letters(F.col("s"), grams.GRAM))).collect()] == [8, 0, 0]


def test_similar_pairs_are_all_found(spark):
    left, right = made(3, 80), made(4, 80)
    for least in (0.3, 0.5, 0.8, 1.0):
        a, b = (spark.createDataFrame([(f"{k}{i}", s) for i, s in enumerate(side)] + [(None, "ab"), ("n", None)], "id string, s string") for k, side in (("a", left), ("b", right)))
        got = {(r["a"], r["b"]): round(r["score"], 9) for r in grams.similar(a, b, least).collect()}
        want = {(f"a{i}", f"b{j}"): round(s, 9) for (i, x), (j, y) in itertools.product(enumerate(left), enumerate(right)) if bigrams(x) and (s := jaccard(bigrams(x), bigrams(y))) >= least}
        assert got == want


def test_pairs_that_the_bounds_exclude_are_not_compared(spark):
    """What is compared has sizes that are near and meets among the first bigrams with enough left."""
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 24))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, s string")
    left = [(r["a"], r["b"]) for r in grams.candidates(rows, rows, 0.7).collect()]
    assert len(left) == len(set(left)) < 0.1 * len(names) ** 2
    df = {}
    for s in names:
        for g in bigrams(s):
            df[g] = df.get(g, 0) + 2
    order = [sorted(bigrams(s), key=lambda g: (df[g], g.hex().upper())) for s in names]
    for i, j in left:
        x, y = order[i], order[j]
        n, m = len(x), len(y)
        first = lambda z: z[: len(z) - -int(-len(z) * 0.7 // 1) + 1]
        assert min(n, m) >= 0.7 * max(n, m) - 1e-9
        assert any(min(n - x.index(g), m - y.index(g)) >= (n + m) * 0.7 / 1.7 - 1e-9 for g in set(first(x)) & set(first(y)))


def test_crosswalk_of_many_names(spark):
    names = spark.range(100_000).select((F.col("id") % 5000).alias("key"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("na"))
    queries = spark.createDataFrame([(1, "name77"), (2, "xxname99999yy"), (3, "me12"), (4, "nothing"), (5, "name")], "q int, nq string")
    got = {}
    for r in rank.crosswalk(queries, names).collect():
        got.setdefault(r["q"], set()).add(r["key"])
    ids = [(i % 5000, f"name{i}") for i in range(100_000)]
    want = {q: {k for k, n in ids if n == nq or (len(nq) >= 6 and (n in nq or nq in n))} for q, nq in ((1, "name77"), (2, "xxname99999yy"))}
    assert got == want


def test_few_strings_in_many(spark, monkeypatch):
    """Rows that repeat are answered one by one, whatever their lengths and the number of letters to find."""
    needles, hays = [*made(6, 40), None, "", "abab", "abab"], [*made(7, 80), None, "", "abab", "abab", "c" * 700 + "abab", "ab" * 600]
    a = spark.createDataFrame(list(enumerate(needles)), "i int, needle string")
    b = spark.createDataFrame(list(enumerate(hays)), "j int, hay string")
    want = sorted((i, j) for (i, x), (j, y) in itertools.product(enumerate(needles), enumerate(hays)) if x and y and x in y)
    for few in (grams.FEW, 5):
        monkeypatch.setattr(grams, "FEW", few)
        assert sorted((r["i"], r["j"]) for r in grams.few_in_many(a, "needle", b, "hay").collect()) == want
        assert grams.few_in_many(a.limit(0), "needle", b, "hay").count() == 0 and grams.few_in_many(a, "needle", b.limit(0), "hay").count() == 0


def test_distinct_keys_of_a_crosswalk(spark, monkeypatch):
    """Ids and keys may be null or repeat, texts of one id may name different keys; each pair comes once."""
    texts, called = [*made(8, 60), None, "", "abcabcabc", "abcabcabc"], [*made(9, 60), None, "", "abcabcabc"]
    queries = [(i % 25 if i % 9 else None, t) for i, t in enumerate(texts)]
    names = [(k % 7 if k % 8 else None, t) for k, t in enumerate(called * 2)]
    q, n = spark.createDataFrame(queries, "id int, nq string"), spark.createDataFrame(names, "key int, na string")
    meets = lambda x, y: bool(x and y) and (x == y or len(x.encode()) >= 6 and (x in y or y in x))
    pairs = [(i, k) for i, x in queries for k, y in names if meets(x, y)]
    key = lambda r: tuple(map(str, r))
    for few in (grams.FEW, 5):
        monkeypatch.setattr(grams, "FEW", few)
        assert sorted((tuple(r) for r in rank.crosswalk_distinct(q, n).collect()), key=key) == sorted(set(pairs), key=key)
        # a row's keys are distinct, and rows that repeat are answered one by one
        each = [(i, k) for i, x in queries for k in {b[0] for b in names if meets(x, b[1])}]
        assert sorted((tuple(r) for r in rank.crosswalk(q, n).select("id", "key").collect()), key=key) == sorted(each, key=key)
    assert rank.crosswalk_distinct(q.limit(0), n).count() == 0 and rank.crosswalk_distinct(q, n.limit(0)).count() == 0


def test_rows_of_a_crosswalk_are_not_shuffled(spark):
    """Each customer has hundreds of keys: what is made distinct is what they are asked by, not the rows."""
    from folioscan.plans.registered import QUERIES

    plan = QUERIES["crosswalk_names"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = plan.split("BroadcastHashJoin", 1)[0]
    assert "Union" in rows and "Aggregate" not in rows and "Exchange" not in rows


def test_a_batch_ranks_equal_texts_once(spark):
    """The k first ids of a title, then the k best of a text, are found before queries meet them: repeats don't multiply."""
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("red ring "), (F.col("id") % 2).cast("string")).alias("text"))
    titles = spark.range(400).select((399 - F.col("id")).alias("id"), F.concat(F.lit("Red ring "), (F.col("id") % 4).cast("string")).alias("title"))
    found = rank.resolve_batch(queries, titles, 0.5, 3)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["id"], r["score"]))
    best = {0: [3, 7, 11], 1: [2, 6, 10]}  # the title with the same number is 399 - id
    assert got.keys() == set(range(300)) and all(sorted(rows) == [(n + 1, i, 1.0) for n, i in enumerate(best[q % 2])] for q, rows in got.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(f"row_number() windowspecdefinition({by}#" in plan for by in ("_t", "_q", "query_id"))
