import re

import pytest
from pyspark.sql import functions as F

from folioscan.operators import fetch, requests, search
from folioscan.sources import catalog

XML = """<TEI><teiHeader>h</teiHeader><charDecl><char xml:id="G1"><mapping type="unicode">龍</mapping></char></charDecl>
<juan n="001" fun="open"/><head>First <hi>one</hi></head>
<lb n='1a'/>alpha <note>a note</note>
<lb ed="T" n = "2a"/>beta <g ref="#G1"/>
<juan fun="close"/>
<juan n="2"/><head>Second</head>
<lb n="1a"/>gamma word
<juan fun="close" n="2"/></TEI>"""


def test_marks():
    found = requests.marks_of(XML)
    assert [(k, n, line) for k, n, line, *_ in found] == [("juan", "001", 2), ("head", "0", 2), ("lb", "1a", 3), ("lb", "2a", 4), ("juan", "2", 6), ("head", "1", 6), ("lb", "1a", 7)]
    part, head = found[0], found[1]
    assert XML[part[3] : part[4]].startswith("<head>First") and XML[part[3] : part[4]].endswith("/>\n") and head[5] == "First <hi>one</hi>" and XML[head[3] : head[4]].endswith('<juan n="2"/>')
    assert requests.marks_of(None) == requests.marks_of("no marks") == [] and requests.marks_of("<juan n='1'>open end")[0][4] == len("<juan n='1'>open end")


def answers(spark, rows, corpus="cbeta", marked_up=True, files=((1, XML), (2, "plain text")), schema=None):
    files = spark.createDataFrame(list(files), "id long, text string")
    names = sorted({k for r in rows for k in r})
    kinds = {**requests.FIELDS, "request_id": "long", "id": "long", "ids": "array<long>"}
    asked = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"{k} {kinds[k]}" for k in names))
    return {r["request_id"]: r for r in requests.fetch_requests(asked, files, corpus=corpus, marked_up=marked_up).collect()}


def test_what_a_request_names_goes_in_order(spark):
    every = {"lb": "1a", "line_number": 4, "part": "2", "head_query": "second", "head_index": 0, "before": 0, "after": 0}
    drop = lambda *names: {k: v for k, v in every.items() if k not in names}
    rows = [every, drop("lb"), drop("lb", "line_number"), drop("lb", "line_number", "part"), drop("lb", "line_number", "part", "head_query"), {}]
    got = answers(spark, [{"request_id": i, "id": 1, **r} for i, r in enumerate(rows)])
    assert [(got[i]["method"], got[i]["passage"]) for i in range(5)] == [("lb-context", "alpha"), ("line-context", "beta"), ("part", "Second gamma word"), ("head-query", "gamma word"), ("head-index", "alpha beta")]
    assert got[5]["method"] == "full" and got[5]["passage"].startswith("h龍 First one") and got[5]["total"] == len(got[5]["passage"])


def test_forms_of_extraction(spark):
    rows = [{"part": "1"}, {"part": "1", "plain": True}, {"part": "1", "plain": True, "notes": True}, {"part": "9"}, {"lb": "9z"}, {"lb": " 2a ", "plain": True, "before": 1, "after": 0}, {"head_index": 7}, {"part": "  "}]
    got = answers(spark, [{"request_id": i, "id": 1, **r} for i, r in enumerate(rows)])
    assert got[0]["passage"] == "First one alpha a note beta 龍"  # a part keeps its notes
    assert got[1]["passage"] == "First one\n\nalpha\n\nbeta 龍" and "[注] a note" in got[2]["passage"]
    assert [got[i]["method"] for i in (3, 4, 5, 6, 7)] == ["full", "full", "lb-context", "full", "full"] and got[4]["passage"] == got[3]["passage"]
    assert got[5]["passage"] == "alpha\n\nbeta 龍"


def test_files_that_are_tried(spark):
    got = answers(spark, [{"request_id": 1, "ids": [9, 2, 1]}, {"request_id": 2, "ids": [9]}, {"request_id": 3, "ids": None}, {"request_id": 4, "ids": [2, 1]}])
    assert [(got[i]["id"], got[i]["method"], got[i]["passage"]) for i in (1, 2, 3, 4)] == [(2, "full", "plain text"), (None, "none", ""), (None, "none", ""), (2, "full", "plain text")]


def test_slices_and_marks(spark):
    text = "\n".join(f"line {i} lotus" for i in range(100))
    rows = [{"page": 1, "page_size": 10, "focus": False}, {"start_char": 5, "end_char": 9}, {"max_chars": 4}, {"full": True}, {"highlight": "line 50"}, {"highlight": "LINE"}, {"highlight": "line (5", "full": True}, {"highlight": "l.tus", "max_chars": 12, "prefix": "$", "suffix": "\\"}]
    got = answers(spark, [{"request_id": i, "id": 1, **r} for i, r in enumerate(rows)], corpus="sarit", marked_up=False, files=[(1, text)])
    assert [got[i]["passage"] for i in (0, 1, 2, 3)] == [text[10:20], text[5:9], text[:4], text] and (got[0]["start"], got[0]["end"], got[0]["total"]) == (10, 20, len(text))
    assert got[4]["method"] == "highlight-context" and got[4]["passage"].startswith("line 47") and ">>> line 50 <<<" in got[4]["passage"] and got[4]["highlighted"] == 1
    assert got[5]["highlighted"] == 0 and got[6]["highlighted"] == 0 and got[7]["passage"] == "line 0 $lotus\\" [:14] and [tuple(p) for p in got[7]["positions"]] == [(7, 12)]


def test_cut_before_or_after_the_marks(spark):
    text = "x" * 5995 + " lotus lotus"
    row = [{"request_id": 1, "id": 1, "highlight": "lotus", "start_char": 0}]
    sizes = {c: (len(a := answers(spark, row, corpus=c, marked_up=False, files=[(1, text)])[1]["passage"]), a.count("<<<")) for c in ("cbeta", "tipitaka", "sarit")}
    assert sizes == {"cbeta": (6000, 0), "tipitaka": (6000, 0), "sarit": (len(text) + 16, 2)}
    shorter = "lotus " + "x" * 7000
    assert len(answers(spark, row, corpus="tipitaka", marked_up=False, files=[(1, shorter)])[1]["passage"]) == 6008


def test_whole_passages(spark, tmp_path):
    """Without a bound nothing is cut, and fetch_by_part's passages are whole."""
    from folioscan.plans.registered import QUERIES

    text = "x" * 5995 + " lotus lotus"
    files = spark.createDataFrame([(1, text)], "id long, text string")
    asked = spark.createDataFrame([(1, 1, "lotus", 0)], "request_id long, id long, highlight string, start_char int")
    for most, sizes in ((None, [len(text) + 16] * 3), (100, [100, 100, len(text) + 16])):
        got = [requests.fetch_requests(asked, files, corpus=c, marked_up=False, most=most).first()["passage"] for c in ("cbeta", "tipitaka", "sarit")]
        assert [len(p) for p in got] == sizes
    long = "\n".join(f"line {i} & more" for i in range(2000))
    spark.createDataFrame([(1, long, "en", "web", len(long)), (2, "short", "en", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["passage"] for r in QUERIES["fetch_by_part"](spark, str(tmp_path)).collect()}
    assert got == {1: "\n".join(["Part two", *(f"again {x}" for x in long.split("\n"))]), 2: "Part two\nagain short"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "request_id long, id long")
    assert requests.fetch_requests(none, spark.createDataFrame([(1, "x")], "id long, text string")).count() == 0
    one = spark.createDataFrame([(1, 1)], "request_id long, id long")
    assert [r["method"] for r in requests.fetch_requests(one, spark.createDataFrame([], "id long, text string")).collect()] == ["none"]


def test_nearest_markers(spark):
    marks = requests.index(spark.createDataFrame([(1, XML), (2, "none")], "id long, text string"), "id")
    places = spark.createDataFrame([(1, k) for k in range(1, 10)] + [(2, 1), (3, 1)], "id long, line int")
    got = {(r["id"], r["line"]): r["lb"] for r in requests.nearest_markers(places, marks).collect()}
    assert [got[1, k] for k in range(1, 10)] == ["1a", "1a", "1a", "2a", "2a", "2a", "1a", "1a", "1a"] and got[2, 1] is None and got[3, 1] is None


@pytest.mark.parametrize("pattern", ["a", "a+", "a*", "é|b", "ab", "x", "(a)(b)?", "[^a]"])
def test_spans_are_the_matches(spark, pattern):
    texts = ["", "a", "aab é ab", "b" * 700 + "a", "ab" * 900, "﷐a﷑", "日本a語"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    at = fetch.highlight_positions(pattern)(F.col("t"))
    for r in rows.select("t", at.alias("at"), fetch.decorated(F.col("t"), at).alias("d"), fetch.highlight(F.col("t"), pattern).alias("h")).collect():
        assert [tuple(p) for p in r["at"]] == [m.span() for m in re.finditer(pattern, r["t"])]
        assert r["d"] == r["h"]


def test_running_sums(spark):
    xs = [[], [3], list(range(1000))]
    rows = spark.createDataFrame([(x,) for x in xs], "x array<bigint>").select("x", fetch.running_sums(F.col("x")).alias("s")).collect()
    assert all(r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))] for r in rows if r["x"])


# --- fallbacks, catalogues -----------------------------------------------------------------------------------------


def test_lists_of_contents_and_numbered_files(spark):
    texts = spark.createDataFrame([("s0404m1.mul.toc", "toc", ""), ("s0404m1.mul0", "zero", ""), ("s0404m1.mul1", "one", ""), ("t.mul.toc", "toc", ""), ("t.mul3", "three", ""), ("t.mul12", "twelve", ""), ("b.mul", " ", "<p>own</p>"), ("b.mul10", "ten", ""), ("b.mul9", "nine", ""), ("c1", "", "<p>bare</p>"), ("c12", "x", ""), ("d.toc", "kept", ""), ("e", None, "<p/>"), ("e0", "", "<i>raw</i>")], "id string, text string, raw string")
    wanted = spark.createDataFrame([(i,) for i in ("s0404m1.mul.toc", "t.mul.toc", "b.mul", "c1", "d.toc", "e", "none", "none.toc")], "id string")
    assert {r["id"]: r["text"] for r in fetch.with_fallbacks(wanted, texts).collect()} == {"s0404m1.mul.toc": "zero", "t.mul.toc": "twelve", "b.mul": "nine", "c1": "bare", "d.toc": "kept", "e": "raw"}


def test_fallbacks_broadcast_nothing(spark):
    """Identifiers, names and texts grow together; a table that is broadcast is held whole by every task's executor."""
    texts = spark.range(4).selectExpr("CASE id WHEN 0 THEN 'a.toc' WHEN 1 THEN 'ab' WHEN 2 THEN 'c' ELSE 'c2' END AS id", "CASE id WHEN 1 THEN 'one' WHEN 3 THEN 'two' END AS text", "'<p>raw</p>' AS raw")  # of known, small size
    found = fetch.with_fallbacks(texts.select("id"), texts)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["text"] for r in found.collect()} == {"a.toc": "one", "ab": "one", "c": "two", "c2": "two"}


def test_marker_context_reads_any_quotes(spark):
    xml = "l1\n<lb n='7'/>l2 <b>x</b>\nl3"
    df = spark.createDataFrame([(xml,)], "x string")
    one = lambda n: df.select(fetch.marker_context(F.col("x"), n, 0, 0)).first()[0]
    assert one("7") == "<lb n='7'/>l2 <b>x</b>" and one("8") == "l1 l2 x l3"
    assert df.select(fetch.marker_context(F.regexp_replace("x", "n='7'", 'n = "7"'), "7", 0, 0)).first()[0] == '<lb n = "7"/>l2 <b>x</b>'


def test_canon_title_and_number_of_a_canonical_file():
    entry = lambda path, xml: catalog._entry("cbeta", path, xml)
    _, title, _, meta = entry("T/T08/X08n0251.xml", "<TEI><text><head>First head</head><head>Second</head></text></TEI>")
    assert title == "First head" and meta["canon"] == "T" and meta["nnum"] == "0251" and meta["indexVersion"] == "cbeta_index_v2"
    _, title, _, meta = entry("Nx0n1.xml", "<TEI/>")
    assert title == "Nx0n1" and "canon" not in meta and "nnum" not in meta


def test_aliases_of_headings_and_of_titles():
    xml = "<TEI>" + "".join(f"<head>Brahmajāla sutta {i}</head>" for i in range(8)) + "</TEI>"
    meta = catalog._entry("tipitaka", "x.xml", xml)[3]
    assert {"Brahmajāla sutta 5", "brahmajala sutta 0", "brahmajaala sutta 5", "Brahmajāla suttanta 0", "brahmajala suttanta 5"} <= set(re.findall(r"[Bb]\w+ \w+ \d", meta["alias"])) and " 6" not in meta["alias"] and "alias_prefix" not in meta
    short = catalog._entry("tipitaka", "x.xml", '<TEI><p rend="nikaya">Saṃyuttanikāya</p><p rend="book">2. Book</p><p rend="chapter">3. Chapter</p></TEI>')[3]
    assert {"SN2.3", "sn02.03", "SNII.3", "SN002", "snii"} <= set(short["alias"].split()) and short["headsPreview"] == ""


def test_validity_by_the_rules_of_a_corpus(spark):
    schema = "path string, meta map<string,string>"
    rows = lambda n, **meta: [(f"{i:03d}", dict(meta)) for i in range(n)]
    paths = spark.createDataFrame([(f"{i:03d}",) for i in range(100)], "path string")

    def valid(entries, corpus, existing=paths):
        return catalog.validity(spark.createDataFrame(entries, schema), existing, corpus).first()["valid"]

    good = {"indexVersion": "cbeta_index_v2"}
    assert valid(rows(30, **good), "cbeta") and not valid(rows(30, indexVersion="v0"), "cbeta") and not valid([("000", None)], "cbeta") and not valid(rows(3, **good), "cbeta", paths.limit(0))
    pali = {"indexVersion": "tipitaka_index_v2", "headsPreview": ""}
    assert valid([*rows(60, **pali), ("0.toc.xml", None)], "tipitaka") and not valid(rows(60, indexVersion="tipitaka_index_v2"), "tipitaka")
    late = rows(60, **pali)
    late[30] = ("030", {**pali, "alias_prefix": "SN", "alias": "SN 1"})
    assert not valid(late, "tipitaka")
    late[30] = ("030", {**pali, "alias_prefix": "SN", "alias": "SN 1.2"})
    late[55] = ("055", {"alias_prefix": "AN"})  # beyond what is looked at
    assert valid(late, "tipitaka") and valid(rows(3), "gretil") and not valid([], "gretil")


def test_script_classes_in_search(spark):
    files = spark.createDataFrame([(1, "abc\n法華 x"), (2, "nothing")], "doc_id int, text string")
    assert [(r["doc_id"], r["line_number"], r["highlight"]) for r in search.hits(files, r"\p{Han}+", "doc_id").collect()] == [(1, 2, "法華")]
