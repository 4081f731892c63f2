"""Paths of identifiers, candidates of queries, stored answers: cases by hand."""

import pytest
from pyspark.sql import functions as F

from folioscan.functions import markup
from folioscan.operators import fetch, grams, paths, rank, search
from folioscan.plans import registry
from folioscan.sources import hits

FILES = {
    "cbeta": ["T/T09/T09n0262.xml", "T/T08/T08n0251.xml", "T/T08/T08n0251a.xml", "X/X01/X01n0001.xml", "x/x01/x01n0001.xml", "misc/note-T9999.xml", None],
    "tipitaka": ["s0101m.mul.xml", "s0102m.mul.xml", "s0103m.mul.xml", "s0201m.mul.xml", "s0202m.mul.xml", "s0101a.att.xml", "s0301m.mul.toc.xml", "s0404m1.mul.xml", "sub/e0101n.mul3.xml", "sub/e0101n.mul12.xml", "sub/Odd7.xml"],
    "gretil": ["sa_x-comm.xml", "sa_x-alt.xml", "sa_xy.xml", "sa_z-comm.xml", "plain.xml", "sub/deep.xml"],
    "sarit": ["a.xml", "transliterated/b.xml", "transliterated/a.xml", "other/c-long.xml", "other/D.XML"],
    "muktabodha": ["m.txt", "n.xml", "n.txt", "sub/Upper.txt", "notes.md"],
}
WANTED = {
    "cbeta": {"T0262": "T/T09/T09n0262.xml", "t0251": "T/T08/T08n0251.xml", "x0001": "X/X01/X01n0001.xml", "T251": None, "T9999": "misc/note-T9999.xml", "T08n0251a": "T/T08/T08n0251a.xml", "T*": None, "": None, None: None},
    "tipitaka": {
        "s0101m.mul": "s0101m.mul.xml", "s0101m": "s0101m.mul.xml", "s0101a": "s0101a.att.xml", "DN": "s0101m.mul.xml", "dn 13": "s0101m.mul.xml", "DN14": "s0102m.mul.xml", "DN24": "s0103m.mul.xml", "MN51": "s0202m.mul.xml", "MN 101": "s0201m.mul.xml",
        "SN1": "s0301m.mul.toc.xml", "AN5.1": "s0404m1.mul.xml", "KN": None, "S0102": "s0102m.mul.xml", "e0101n.mul": "sub/e0101n.mul3.xml", "odd": "sub/Odd7.xml", "none": None,
    },
    "gretil": {"x": "sa_xy.xml", "z": "sa_z-comm.xml", "sa_z": "sa_z-comm.xml", "plain": "plain.xml", "Y": "sa_xy.xml", "EE": "sub/deep.xml", "q": None},
    "sarit": {"a": "a.xml", "a.xml": "a.xml", "b": "transliterated/b.xml", "transliterated/b": None, "C": "other/c-long.xml", "d": "other/D.XML", "../a": None},
    "muktabodha": {"m": "m.txt", "n": "n.xml", "n.txt": "n.txt", "notes.md": "notes.md", "upper": "sub/Upper.txt", "sub/Upper": None, "M": "m.txt"},
}


@pytest.mark.parametrize("corpus", FILES)
def test_rules(spark, corpus):
    # repeated rows and columns of other names change nothing
    files = spark.createDataFrame([(p, "k", "0") for p in FILES[corpus] * 2], "path string, kind string, key string")
    wanted = spark.createDataFrame([(w, 1) for w in [*WANTED[corpus], "a"]], "wanted_id string, path int")
    got = {r["wanted_id"]: r["path"] for r in paths.resolve(files, wanted, corpus).collect()}
    assert {k: got[k] for k in WANTED[corpus]} == WANTED[corpus] and len(got) == len({*WANTED[corpus], "a"})
    assert paths.resolve(files.limit(0), wanted, corpus).filter("path IS NOT NULL").count() == 0 and paths.resolve(files, wanted.limit(0), corpus).count() == 0


def test_identifier_goes_before_a_query(spark):
    files = spark.createDataFrame([("a.xml",), ("b.xml",)], "path string")
    catalogue = rank.with_hay(spark.createDataFrame([("a.xml", "a", "Heart"), ("b.xml", "b", "Lotus")], "path string, id string, title string"), F.col("title"))
    assert [r[0] for r in paths.one(files, catalogue, "sarit", "a", "Lotus").collect()] == ["a.xml"] and [r[0] for r in paths.one(files, catalogue, "sarit", query="lotus").collect()] == ["b.xml"]
    assert paths.one(files, catalogue, "sarit", "none", "Lotus").count() == 0 and paths.one(files, catalogue, "sarit").count() == 0


def test_resolve_query(spark):
    titles = [spark.createDataFrame([("cbeta", "T0262", "t", 0.9), ("cbeta", "T1", "u", 0.5), ("cbeta", "T2", "v", 0.05)], "source string, id string, title string, score double")]
    named = [(r["source"], r["id"], r["rank_score"]) for r in rank.resolve_query(spark, "法華経", titles, preferred="gretil").collect()]
    assert named == [("gretil", "saddharmapuNDarIka", 1.07), ("cbeta", "T0262", 1.05), ("cbeta", "T1", 0.5)]
    assert [(r["id"], r["rank_score"]) for r in rank.resolve_query(spark, "T262", titles).collect()] == [("T0262", 1.2)]
    assert [r["id"] for r in rank.resolve_query(spark, "nothing", titles, limit=1).collect()] == ["T0262"] and rank.resolve_query(spark, "nothing", []).count() == 0
    asked = spark.createDataFrame([(1, None), (2, " "), (3, "般若波羅蜜多心經")], "n int, q string")
    assert [(r["n"], [c["id"] for c in r["candidates"]], r["direct"]) for r in rank.given_candidates(asked, "q").orderBy("n").collect()] == [(1, [], False), (2, [], False), (3, ["T0251", "prajJApAramitAhRdayasUtra"], False)]


def test_blank_query_is_held_by_no_body(spark):
    docs = spark.createDataFrame([(0, "x", "any"), (1, "y", None)], "pos int, title string, body string")
    assert {r["tier"] for r in rank.pick_by_tier(docs, " - ", "body", "title", "pos").collect()} == {2}
    assert [r["pos"] for r in rank.pick_by_tier(spark.createDataFrame([(0, "x", "no"), (1, "y", "the LO-TUS")], "pos int, title string, body string"), "lotus", "body", "title", "pos").collect()] == [1, 0]


def test_stored_answers(spark):
    rows = [("k", "u", None, None, None, None), (None, None, "http://api.adarshah.org/x", None, None, None), (None, "I1", None, None, None, None), (None, None, None, "k", "s", "p"), ("bdrc", None, None, "k", "s", "p"), (None,) * 6]
    df = spark.createDataFrame(rows, "source string, id string, url string, kdb string, sutra string, page string")
    assert [r[0] for r in df.select(hits.backend_of(*[F.col(c) for c in df.columns])).collect()] == ["buda", "adarsha", "buda", "adarsha", "buda", None]
    one = spark.createDataFrame([('[{"pbName":"1a","text":"<p>x  y</p>"},{"pbName":"1b","text":" "},{"text":"z"}]',), ("",), (None,)], "a string")
    assert [r[0] for r in one.select(hits.page_lines(F.col("a"))).collect()] == ["1a: x y\n: z", None, None]
    urls = spark.createDataFrame([("https://github.com/Openpecha-Data/P1.git",), ("x github.com/Openpecha-Data/P2#a",), ("https://example.org/P3",), (None,)], "u string")
    assert [r[0] for r in urls.select(hits.repository_name(F.col("u"))).collect()] == ["P1", "P2", None, None]
    answers = spark.createDataFrame([("",), ("{}",), ('{"response":{"docs":[]}}',), (None,)], "a string")
    assert hits.searched(answers, "a").count() == 0 and hits.page_hits(answers, "a").count() == 0
    pages = spark.createDataFrame([], "key string, html string")
    assert [tuple(r) for r in fetch.fetch_stored(spark.createDataFrame([("u",)], "url string"), pages, "q").collect()] == [("u", "", 0, 0, 0)]
    assert fetch.online_pipeline(hits.searched(answers, "a"), pages, "q", "b").count() == 0


def test_part_argument():
    assert [fetch.part_argument(v) for v in (" 3 ", "", 7, -1, True, 1.5, None)] == ["3", None, "7", None, None, None, None]


def test_rewritten():
    meta = {"pick": {"fetch": {"tool": "cbeta_fetch", "args": {"id": "T1"}}}, "candidates": [{"fetch": {"tool": "gretil_fetch"}}, {"id": 1}], "fetchSuggestions": [{"tool": "other"}], "pipelineHint": {"tool": "sat_pipeline", "args": {}}, "n": 1}
    assert registry.rewritten(meta) == {
        "pick": {"fetch": {"tool": "fetch", "args": {"source": "cbeta", "id": "T1"}}}, "candidates": [{"fetch": {"tool": "fetch", "args": {"source": "gretil"}}}, {"id": 1}],
        "fetchSuggestions": [{"tool": "other"}], "pipelineHint": {"tool": "pipeline", "args": {"source": "sat"}}, "n": 1,
    }


def test_printed(spark):
    found = spark.createDataFrame([("b", "B", "p/b", 0.5), ("a", None, "p/a", 0.5), ("c", "C", "p/c", 0.9)], "id string, title string, path string, score double")
    assert rank.printed(found).first()[0] == "1. c  C\n2. a  \n3. b  B" and rank.printed(found.limit(0)).first()[0] == ""
    assert rank.printed(found.limit(1), as_json=True).first()[0] == '{"count":1,"results":[{"id":"b","title":"B","path":"p/b","score":0.5}]}'


def test_percentiles_of_outliers_and_ties(spark):
    values = [1e18, -1e18, *[5.0] * 400, *[k / 7 for k in range(3000)]]
    got = rank.percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()
    ordered = sorted(values)
    assert [got[f"p{p}"] for p in (50, 90, 95, 99)] == [ordered[int(p / 100 * (len(values) - 1) + 0.5)] for p in (50, 90, 95, 99)] and got["n"] == len(values)
    assert rank.percentiles(spark.createDataFrame([(2.0,)], "v double"), "v").first()["p99"] == 2.0


def test_ids_that_begin_so_are_shown_first(spark):
    found = spark.createDataFrame([("A9", 0, 5), ("T1", 0, 1), ("T2", 1, 9), ("B1", 1, 8)], "id string, t int, total_matches int")
    assert [r["id"] for r in search.tiered(found, F.col("t"), "id", 3, "T").collect()] == ["T2", "T1", "A9"]


def test_structure(spark):
    xml = "<TEI><!-- c --><div n='1' type='a'/><div n='2'/><p>ab</p><p>12345</p><p>abcdef</p></TEI>"
    assert markup.structure(xml) == ("abcdef · 12345", ["1(a)"]) and markup.structure(None) == ("", []) and markup.structure("<p>" * 5001 + "long text") == ("", [])
    found = spark.createDataFrame([("f", "x y", [(1, "x", "x")])], "id string, text string, matches array<struct<line_number:int,context:string,highlight:string>>")
    row = search.structured(found, "id").first()
    assert row["title"] == "f" and row["structure_info"] == [] and row["matches"][0]["section"] is None


def test_tables_that_grow_are_not_broadcast(spark):
    """A broadcast table is held by the driver, so no join of identifiers, files or grams has one."""
    files = spark.range(2).selectExpr("CASE id WHEN 0 THEN 'a1.xml' ELSE 'deep/b12.xml' END AS path")  # of known, small size
    wanted = spark.range(3).selectExpr("CASE id WHEN 0 THEN 'a1' WHEN 1 THEN '12' ELSE 'none' END AS wanted_id")
    found = paths.resolve(files, wanted, "sarit")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["wanted_id"]: r["path"] for r in found.collect()} == {"a1": "a1.xml", "12": "deep/b12.xml", "none": None}


def test_keys_are_made_by_compiled_expressions(spark):
    """Casts that fail throw inside, and functions of arrays are interpreted: each made most of the time of a lookup."""
    files = spark.range(1).selectExpr("'a7.xml' AS path")
    plan = paths.resolve(files, spark.range(1).selectExpr("'a7' AS wanted_id"), "muktabodha")._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan and "lambdafunction" not in plan
    names = spark.createDataFrame([("b.xml",), ("n007.xml",), ("n99999999999.xml",), ("n4294967295.xml",), ("n4294967296.xml",)], "path string")
    numbers = paths._named(names).select("name", paths._number(F.col("digits")).alias("n"))
    assert "try_cast(regexp_extract" not in numbers._jdf.queryExecution().optimizedPlan().toString()
    assert {r["name"]: r["n"] for r in numbers.collect()} == {"b.xml": None, "n007.xml": 7, "n99999999999.xml": None, "n4294967295.xml": 4294967295, "n4294967296.xml": None}
    # the ten digits at the end of a stem count as a number where they are small enough
    found = paths.resolve(names, spark.createDataFrame([("n",), ("n0",), ("n9",), ("n42949672",)], "wanted_id string"), "tipitaka")
    assert {r["wanted_id"]: r["path"] for r in found.collect()} == {"n": "n007.xml", "n0": "n007.xml", "n9": "n99999999999.xml", "n42949672": "n4294967295.xml"}


def test_identifiers_are_dealt(spark):
    """A file of few bytes may hold all identifiers; they aren't told apart by one task."""
    ids = spark.range(2).selectExpr("CASE id WHEN 0 THEN 'a7' ELSE 'none' END AS wanted_id")
    found = paths.resolve(spark.range(1).selectExpr("'a7.xml' AS path"), ids, "muktabodha")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # both where identifiers ask for keys and where they get their paths, besides the files
    assert plan.count("Repartition ") == 3 and {r["wanted_id"]: r["path"] for r in found.collect()} == {"a7": "a7.xml", "none": None}


def test_parts_are_dealt(spark, monkeypatch):
    """Identifiers that are left for parts are few bytes, but their grams are many; they aren't taken apart by one task."""
    given = []
    inner = grams.containment
    monkeypatch.setattr(grams, "containment", lambda needles, *rest: given.append(needles.rdd.getNumPartitions()) or inner(needles, *rest))
    found = paths.resolve(spark.range(1).selectExpr("'sa_xy.xml' AS path"), spark.range(2).selectExpr("CASE id WHEN 0 THEN 'Y' ELSE 'none' END AS wanted_id"), "gretil")
    assert {r["wanted_id"]: r["path"] for r in found.collect()} == {"Y": "sa_xy.xml", "none": None} and given == [3 * spark.sparkContext.defaultParallelism]
