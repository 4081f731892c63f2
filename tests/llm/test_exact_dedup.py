import hashlib
import re
from collections import defaultdict

import pytest

from folioscan.llm import exact_dedup as D

from .conftest import odd_rows


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for norm, rs in groups.items():
        keep = min(rs, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out += [(r[0], keep, len(rs), r[0] == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in rs]
    return sorted(out, key=str)


def test_decisions_match_brute_force(spark, odd):
    got = [tuple(r) for r in D.decide(odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute(odd_rows())


def test_dedup_keeps_columns_and_one_row_of_each_group(odd):
    out = D.dedup(odd)
    assert out.schema.simpleString() == odd.schema.simpleString()
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in out.collect()]
    assert set(texts) == {b for r in odd_rows() for b in [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")]}


def test_dedup_counts_one_row_of_each_group(spark, odd):
    rows = [r["text"] for r in D.dedup(odd).collect()]
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in odd_rows()})
    copies = [(1, "one text", "a"), (1, "one text", "a"), (1, "one\ttext", "b"), (None, "two", "a"), (None, "two", "a"), (None, "two", None), (2, "three", "a"), (None, "three", "a")]
    docs = spark.createDataFrame(copies, "doc_id long, text string, source string").repartition(3)
    out = D.dedup(docs).collect()
    assert sorted((re.sub(r"\s", "", r["text"]), r["doc_id"] or 0) for r in out) == [("onetext", 1), ("three", 2), ("two", 0)]
    assert sorted(map(str, out)) == sorted(map(str, D.dedup(docs.repartition(2)).collect()))


def test_a_filter_that_is_not_broadcast_gives_the_same(odd, monkeypatch):
    monkeypatch.setattr(D, "FILTER_ROWS", 0)
    got = [tuple(r) for r in D.decide(odd).collect()]
    assert sorted(got, key=str) == brute(odd_rows())
    assert D.dedup(odd).count() == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in odd_rows()})


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_only_possible_copies_pass_the_filter(spark, most, monkeypatch):
    """The filter grows with the rows, broadcast or not: few unique rows are suspected, and every copy is."""
    monkeypatch.setattr(D, "FILTER_ROWS", most)
    docs = spark.range(60_000).selectExpr("'text number ' || if(id % 1000 = 7, 7, id) AS text")
    digests = D.common.materialise(docs.select(D._digest(docs["text"]).alias("digest")), "test")
    filt = D.Filter(digests)
    assert filt.small == (most > 0)
    maybe = filt.tested(digests).groupBy("_maybe").count().collect()
    n = {r["_maybe"]: r["count"] for r in maybe}
    assert n[True] + n[False] == 60_000 and 60 <= n[True] < 60 + 600


def test_empty(empty):
    assert D.decide(empty).count() == 0 and D.dedup(empty).count() == 0
