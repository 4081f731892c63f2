import pytest

from folioscan.llm import url_filter as U

URLS = [
    ("https://a.example.com/en/12?x=1", "a.example.com", "/en/12", "com/en/", "block"), ("http://EXAMPLE.com/en/77#t", "example.com", "/en/77", "example.com/en/7", "allow"),
    ("http://x.y.net/de/5", "x.y.net", "/de/5", "net/de/", "allow"), ("http://www.example.net/de/8", "www.example.net", "/de/8", "example.net/de/8", "block"),
    ("http://z.org/es/", "z.org", "/es/", "org/es/", "block"), ("ftp://lucky-casino-slots.example.info/bonus/free-spins", "lucky-casino-slots.example.info", "/bonus/free-spins", None, "block"),
    ("http://notexample.com/fr", "notexample.com", "/fr", None, None), ("no url", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("http://library.example.org/fr/1?u=http://casino.example.com/en/", "library.example.org", "/fr/1", None, "allow"),
]


def test_rules_and_parts(spark):
    rows = U.judge(spark.createDataFrame([(u, "x", i) for i, (u, *_) in enumerate(URLS)], "url string, host string, n int")).orderBy("n").collect()
    for r, (_, host, path, rule, verdict) in zip(rows, URLS, strict=True):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict in (None, r["verdict"])


def test_score_matches_the_plain_model(spark):
    w = U.weights()
    parts = [("www.casino.example.com", "/en/1"), ("journal.example.org", "/fr/7.html"), ("ab", ""), ("", ""), ("é" * 3, "/x" * 4000)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(parts, "h string, p string").select("h", "p", U.model_score(F.col("h"), F.col("p")).alias("s"))
    for r in df.collect():
        assert r["s"] == pytest.approx(sum(w[b] for b in U._buckets(r["h"], r["p"])) + w[-1], abs=2e-6)


def test_the_model_learns_its_table():
    w = U.weights()
    assert all((sum(w[b] for b in U._buckets(h, p)) + w[-1] > 0) == bool(y) for h, p, y in U.labelled())


def test_accuracy_on_held_out_urls():
    assert U.held_out_accuracy() >= 0.85


def test_the_table_holds_none_of_the_given_hosts(spark):
    hosts = {r["h"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select(U.host_of(U.F.col("url")).alias("h")).distinct().collect()}
    names = {n for h in hosts for n in h.split(".") if len(n) > 4 and n != "example"}
    assert not any(h in hosts or names & set(h.split(".")) for h, _, _ in U.labelled())


def test_odd_urls(spark):
    """Repeated, null and very long urls, clashing names, and a url column called like a result."""
    urls = ["http://a.example.com/en/1", "http://a.example.com/en/1", None, "", "x" * 50_000, "http://h.example/" + "free-casino/" * 5000, "http://é.example/ü"]
    rows = [(u, "r", 1.5, i, None) for i, u in enumerate(urls)]
    out = U.judge(spark.createDataFrame(rows, "host string, rule string, score double, n int, `a.b` string"), "host")
    assert out.columns == ["n", "a.b", *U.RESULTS]
    got = out.orderBy("n").collect()
    assert tuple(got[0])[2:] == tuple(got[1])[2:] and got[0]["verdict"] == "block" and got[0]["rule"] == "com/en/"
    assert [got[i]["host"] for i in (2, 3, 4)] == [""] * 3 and len({got[i]["verdict"] for i in (2, 3, 4)}) == 1
    assert got[5]["verdict"] == "block" and got[6]["host"] == "é.example"


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "url string")).count() == 0
