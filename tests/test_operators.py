import pytest
from pyspark.sql import functions as F

from folioscan.operators import fetch, rank, search
from folioscan.streaming import incremental

FILES = [("T1", "T", "x lotus\nnone\nLotus lotus\n"), ("T2", "T", "lotus"), ("A1", "A", "lotus\nlotus\nlotus\nlotus"), ("A2", "A", "nothing"), ("B1", "A", "lotus\0lotus"), ("C1", "A", ""), ("D1", "A", None)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "id string, tier string, text string")


def test_grep_caps_and_orders(files):
    found = search.grep(files, "lotus", 3)
    assert {r["id"]: r["total_matches"] for r in found.collect()} == {"T1": 2, "T2": 1, "A1": 3}
    first = found.filter("id = 'T1'").first()["matches"]
    assert [(m["line_number"], m["context"], m["highlight"]) for m in first] == [(1, "x lotus", "lotus"), (3, "Lotus lotus", "Lotus")]
    assert [r["id"] for r in search.best_first(found, "id", 2).collect()] == ["A1", "T1"]
    tier = F.when(F.col("tier") == "T", 0).otherwise(1)
    for n in (1, 2, 3):
        assert [r["id"] for r in search.tiered(found, tier, "id", n).collect()] == ["T1", "T2", "A1"][:n]
    assert [r["id"] for r in search.path_order(found, "id", 2).collect()] == ["A1", "T1"]


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_order_does_not_depend_on_partitions(files, partitions):
    found = search.grep(files.repartition(partitions), "lotus", 5)
    assert [r["id"] for r in search.tiered(found, F.when(F.col("tier") == "T", 0).otherwise(1), "id", 2).collect()] == ["T1", "T2"]


def test_invalid_patterns_and_zero(files):
    assert search.grep(files, "(", 3).count() == 0 and search.grep(files, "lotus", 0).count() == 0 and search.grep(files, "(?<=x)l", 3).count() == 0


def test_grep_needs_no_shuffle(files):
    plan = search.grep(files, "lotus", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_context_and_pipeline(files):
    wanted = files.sparkSession.createDataFrame([("T1", 1), ("T1", 3), ("T1", 4), ("T1", 0)], "id string, line_number int")
    got = {r["line_number"]: r["passage"] for r in search.context(files, wanted, "id", 1, 1).collect()}
    assert got == {1: "x lotus\nnone", 3: "none\nLotus lotus", 4: "", 0: ""}
    rows = {r["id"]: r["passages"] for r in search.search_to_context(files, "lotus", "id", before=0, after=0).collect()}
    assert rows["T1"] == "x >>> lotus <<<\n---\n>>> Lotus <<< >>> lotus <<<"
    assert [tuple(r) for r in search.suggestions(search.grep(files, "lotus", 5), "id").collect()] == [("A1", 1, 1, 4)]
    assert search.summary(search.grep(files, "lotus", 5)).filter("id = 'A1'").first()["summary"] == "lotus\nlotus\n... and 2 more"


def test_spill(spark):
    rows = search.spill(spark.createDataFrame([("a" * 30,), ("b",)], "t string"), "t", inline=10, preview=4).orderBy("t").collect()
    assert [(r["spilled"], r["shown"], len(r["key"])) for r in rows] == [(True, "aaaa", 12), (False, "b", 12)]
    assert not search.spill(spark.createDataFrame([("a" * 30,)], "t string"), "t", inline=0).first()["spilled"]


def cell(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("args", "want"), [({"page": 1, "page_size": 2}, ("cd", 5, 2, 4)), ({"start": 3, "most": 9}, ("dé", 5, 3, 5)), ({"start": 1, "end": 3, "most": 1}, ("bc", 5, 1, 3)), ({"start": 9}, ("", 5, 5, 5)), ({"start": 3, "end": 1}, ("", 5, 3, 3)), ({}, ("abcdé", 5, 0, 5))])
def test_slices(spark, args, want):
    assert tuple(cell(spark, "abcdé", lambda c: fetch.char_slice(c, **args))) == want


def test_anchors(spark):
    df = spark.createDataFrame([('a<lb n="1"/>b<lb n="2"/>X<lb n="3"/>', "X"), ('a<lb n="1"/>', "q"), ("a", "a")], "l string, a string")
    assert [r[0] for r in df.select(fetch.marker_near(F.col("l"), F.col("a"))).collect()] == ["2", "1", None]
    xml = 'l1\nl2 <lb n="9"/>\nl3\nl4'
    assert cell(spark, xml, lambda c: fetch.marker_context(c, "9", 0, 1)) == 'l2 <lb n="9"/>\nl3'
    assert cell(spark, xml, lambda c: fetch.marker_context(c, "8", 0, 1)) == "l1 l2 l3 l4"


def test_sections(spark):
    xml = "p<head>One <i>x</i></head>first<head>Two</head>second"
    assert cell(spark, xml, fetch.heads) == ["One x", "Two"]
    assert cell(spark, xml, lambda c: fetch.section_by_head(c, query="tWo")) == "second" and cell(spark, xml, lambda c: fetch.section_by_head(c, index=0)) == "first"
    assert cell(spark, xml, lambda c: fetch.section_by_head(c, index=2)) is None and cell(spark, "none", lambda c: fetch.section_by_head(c, query="x")) is None


def test_highlights(spark):
    assert cell(spark, "a$b a", lambda c: fetch.highlight(c, "a", "$", "\\")) == "$a\\$b $a\\"
    assert cell(spark, "a.b axb", lambda c: fetch.highlight_count(c, "a.b")) == 2 and cell(spark, "a.b axb", lambda c: fetch.highlight_count(c, "a.b", is_regex=False)) == 1
    assert cell(spark, "é aa", fetch.highlight_positions("a")) == [(2, 3), (3, 4)] and cell(spark, "x", fetch.highlight_positions("(")) == []
    assert cell(spark, "l1\nl2\nhit\nl4", lambda c: fetch.focus(c, "hit", 1, 0)) == "l2\nhit" and cell(spark, "x" * 80 + "hit", lambda c: fetch.focus_offset(c, "hit")) == 30


def test_fetch_precedence(spark):
    docs = spark.createDataFrame([(1, 'a\n<lb n="2"/>b\nc hit'), (2, "other")], "id int, text string")
    assert fetch.fetch(docs, "id", 1, line=3, before=0, after=0, pattern="hit").first()["passage"] == "c >>> hit <<<"
    assert fetch.fetch(docs, "id", 1, line=3, marker="2", before=0, after=0).first()["passage"] == '<lb n="2"/>b'
    assert fetch.fetch(docs, "id", 1, start=0, most=1).first()["passage"] == "a"


ENTRIES = [("T0001", "Lotus Sutra", {"alias": "DN1 DN01", "author": "Dharma Rakṣa"}), ("X2", "Diamond Sutra 12.2", None), ("X3", "other", {"z": "9", "a": "lotus"})]


@pytest.fixture(scope="module")
def entries(spark):
    df = spark.createDataFrame(ENTRIES, "id string, title string, meta map<string,string>")
    df = df.withColumns({"alias": F.col("meta")["alias"], "author": F.col("meta")["author"]})
    return rank.with_hay(df, rank.haystack(F.col("title"), F.col("id"), F.col("meta")))


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


def test_title_search(entries):
    assert scores(rank.title_search(entries, "lotus"))["T0001"] == 1.0 and scores(rank.title_search(entries, "lotus"))["X3"] == 1.0
    assert scores(rank.title_search(entries, "dn01", alias="alias"))["T0001"] >= rank.ALIAS
    assert scores(rank.title_search(entries, "Dharmaraksa", contributors=("author",)))["T0001"] >= rank.CONTRIBUTOR
    assert scores(rank.title_search(entries, "ltssutr"))["T0001"] >= rank.SUBSEQUENCE
    assert scores(rank.title_search(entries, "")) == {"T0001": 1.0, "X2": 1.0, "X3": 1.0}
    assert [r["id"] for r in rank.title_search(entries, "", limit=2).collect()] == ["T0001", "X2"] and rank.title_search(entries, "x", limit=0).count() == 0
    near = rank.base_score(F.col("hay_norm"), F.col("hay_ws"), "diamond 12.2 book")
    boosted = rank.match_score(F.col("hay_norm"), F.col("hay_ws"), "12.2 zz")
    assert entries.filter("id = 'X2'").select(near.alias("n")).first()["n"] < 0.95 and entries.filter("id = 'X2'").select(boosted).first()[0] < 1


def test_haystack_sorts_keys(spark):
    df = spark.createDataFrame(ENTRIES, "id string, title string, meta map<string,string>")
    assert [r[0] for r in df.select(rank.haystack(F.col("title"), F.col("id"), F.col("meta"))).collect()] == ["Lotus Sutra T0001 DN1 DN01 Dharma Rakṣa", "Diamond Sutra 12.2 X2 ", "other X3 lotus 9"]


def test_canon_bias(spark):
    df = spark.createDataFrame([("T1", "T"), ("T2", "X"), ("A", None)], "id string, canon string")
    assert [r[0] for r in df.select(rank.canon_bias(F.lit(1.0), F.col("canon"), F.col("id"))).collect()] == pytest.approx([1.02, 1.01, 1.0])


def test_resolve(spark):
    s = "source string, id string, title string, score double"
    a = spark.createDataFrame([("a", "1", "x", 0.9), ("a", "2", "y", 0.05), ("a", "3", "z", 0.5)], s)
    b = spark.createDataFrame([("b", "1", "x", 0.89), ("a", "1", "again", 0.99)], s)
    rows = [(r["source"], r["id"], r["title"]) for r in rank.resolve(spark, [a, b], preferred="b").collect()]
    assert rows == [("a", "1", "again"), ("b", "1", "x"), ("a", "3", "z")]
    assert rank.resolve(spark, [a, b], limit=0).count() == 1


def test_direct_ids(spark):
    every = ["cbeta", "tipitaka"]
    asked = spark.createDataFrame([(0, "t 262"), (1, "DN a1b2"), (2, "lotus"), (3, None)], "n int, q string")
    found = [[(c["source"], c["id"]) for c in r["found"]] for r in asked.select("n", rank.direct_candidates(F.coalesce("q", F.lit("")), tuple(every)).alias("found")).orderBy("n").collect()]
    assert found == [[("cbeta", "T0262")], [("tipitaka", "DN12")], [], []]


def test_crosswalk(spark):
    aliases = spark.createDataFrame([("heart", "心經"), ("heart", "heartsutra"), ("lotus", "lotussutra")], "key string, na string")
    queries = spark.createDataFrame([(1, "心經"), (2, "heart"), (3, "theheartsutraandlotussutra"), (4, "lotu"), (5, "般若心經")], "q int, nq string")
    got = {(r["q"], r["key"]) for r in rank.crosswalk(queries, aliases).collect()}
    assert got == {(1, "heart"), (3, "heart"), (3, "lotus"), (5, "heart")}


def test_lookup(spark):
    catalog = spark.createDataFrame([("base1", "/b1"), ("base0", "/b0"), ("sa_x", "/sx"), ("Y", "/y"), ("y", "/y2")], "id string, path string")
    wanted = spark.createDataFrame([("base",), ("x",), ("y",), ("Base0",), ("q",)], "wanted_id string")
    assert {r[0]: r[1] for r in rank.lookup(catalog, wanted).collect()} == {"base": "/b0", "x": "/sx", "y": "/y2", "Base0": "/b0"}


def test_pick_by_tier(spark):
    docs = spark.createDataFrame([(0, "heart sutra", ""), (1, "x", "the lotus here"), (2, "Lotus", ""), (3, "lotus too", "lotus")], "pos int, title string, body string")
    assert [r["pos"] for r in rank.pick_by_tier(docs, "lotus", "body", "title", "pos").collect()] == [1, 3, 2, 0]


def test_merges(spark):
    s = "url string, title string, score double, pos int"
    a, b = spark.createDataFrame([("u1", "a", 0.1, 0), ("u2", "b", 0.9, 1)], s), spark.createDataFrame([("u2", "c", 0.5, 0), ("u3", "d", 0.3, 1)], s)
    assert [r["url"] for r in rank.merge_by_url([a, b], 10).collect()] == ["u1", "u2", "u3"] and [r["url"] for r in rank.merge_by_url([a, b], 2, by_score=True).collect()] == ["u2", "u3"]
    assert [r["url"] for r in rank.distinct_paged(a.union(b), "url", "pos", 2, 1).collect()] in (["u2", "u3"], ["u2", "u1"], ["u3"], ["u1", "u3"], ["u2", "u3"])


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [float(x * x % 97) for x in range(500)], [3.0] * 50 + [1e9]])
def test_percentiles(spark, values):
    r = rank.percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()
    s, n = sorted(values), len(values)
    assert (r["n"], r["min"], r["max"]) == (n, s[0], s[-1])
    for p in (50, 90, 95, 99):
        assert r[f"p{p}"] == s[int(p / 100 * (n - 1) + 0.5)]


def test_percentiles_of_nothing(spark):
    assert rank.percentiles(spark.createDataFrame([], "v double"), "v").first()["n"] == 0


def test_stream(spark, tmp_path):
    schema = "id string, text string"
    spark.createDataFrame([("a", "x lotus"), ("b", "none")], schema).write.parquet(str(tmp_path / "in"))
    stream = incremental.watch(spark, str(tmp_path / "in"), schema, "lotus")
    assert stream.isStreaming
    incremental.keep(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([("c", "Lotus")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.keep(incremental.watch(spark, str(tmp_path / "in"), schema, "lotus"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]


def test_probe_and_fallbacks(spark):
    candidates = spark.createDataFrame([("u0", 0), ("u1", 1), ("u2", 2), ("u9", 9)], "url string, pos int")
    pages = spark.createDataFrame([("u0", ""), ("u1", "some text"), ("u2", "a lotus"), ("u9", "lotus")], "url string, text string")
    assert rank.probe(candidates, pages, "lotus").first()["url"] == "u2" and rank.probe(candidates, pages, "nope").first()["url"] == "u1" and rank.probe(candidates, pages, "lotus", 1).count() == 0
    texts = spark.createDataFrame([("a", " ", None), ("b", "", "<p> </p>"), ("b1", "first", ""), ("c", None, "<p>con<b/>tent</p>")], "id string, text string, raw string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c.toc",), ("z",)], "id string")
    assert {r["id"]: r["text"] for r in fetch.with_fallbacks(wanted, texts).collect()} == {"b": "first", "c.toc": "con tent"}


def test_folded_terms_of_title_scores(spark):
    rows = spark.createDataFrame([("zzzz", "zzzz", "abcd", "x"), ("zzzz", "zzzz", "a1b2c3", "x"), ("zzzz", "zzzz", "zzzz", "x abc")], "hay_norm string, hay_ws string, fold string, alias string")
    plain = rank.match_score(F.col("hay_norm"), F.col("hay_ws"), "abc", F.lit("x"))
    folded = rank.base_score(F.col("hay_norm"), F.col("hay_ws"), "xabc", F.col("fold"))
    whole = rank.match_score(F.col("hay_norm"), F.col("hay_ws"), "abc", F.col("alias"), F.col("fold"))
    got = [tuple(r) for r in rows.select(plain, F.round(folded, 6), whole).collect()]
    assert got == [(0.0, 0.5, 0.85), (0.0, 0.0, 0.85), (0.0, 0.0, 0.95)]


def test_the_lines_of_a_file_are_searched_once(spark):
    """The executed plan holds the expression once: filtering on the matches doesn't evaluate them again."""
    files = spark.createDataFrame([(1, "a word  \nno\nWORDS")], "id long, text string")
    found = search.best_first(search.grep(files, "wor(d|k)"), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("split(") == 1
    assert [tuple(m) for m in found.first()["matches"]] == [(1, "a word", "word"), (3, "WORDS", "WORD")]
    assert [m["line_number"] for m in search.grep(files, "word$").first()["matches"]] == [1]


def test_candidates_are_computed_once_for_each_row(spark):
    """The plan has the names of the works once, so its size doesn't hold their product with what refers to them."""
    rows = spark.createDataFrame([("T0251",), ("Heart Sutra",), ("",), (None,)], "q string")
    found = rank.given_candidates(rows, "q", limit=100)
    plan = found.select(F.explode_outer("candidates").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    name = rank.T.python_normalised("Heart Sutra")
    assert plan.count(name) <= 2 * sum(name == rank.T.python_normalised(n) for names, _ in rank.CROSSWALK_WORKS.values() for n in names)
    assert [[c["id"] for c in r["candidates"]] for r in found.collect()] == [["T0251", "prajJApAramitAhRdayasUtra"], ["T0251", "prajJApAramitAhRdayasUtra"], [], []]
