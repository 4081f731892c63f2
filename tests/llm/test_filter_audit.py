import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscan.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def model(rows, labels):
    """rows (doc_id, text, lang): every order run over every document, one by one."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    bad = {d for d, _, t in labels if d is not None and t == 1}
    docs = []
    for d, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows),
        }
        docs.append((d, lang or "", fails))
    out = defaultdict(lambda: [0] * 6)
    for order in map("".join, permutations("ABCDE")):
        for d, part, fails in docs:
            gone = next((k for k, f in enumerate(order) if fails[f]), 5)
            for k, f in enumerate(order):
                r = out[part, order, k + 1]
                r[0] += gone > k
                r[1] += gone == k
                r[2] += fails[f] and gone < k
                r[3] += fails[f] and sum(fails.values()) == 1
                r[4] += gone == k and d in good
                r[5] += gone == k and d in bad
    shapley = defaultdict(int)
    for (part, order, k), r in out.items():
        shapley[part, order[k - 1]] += r[1]
    return {key: (*r, shapley[key[0], key[1][key[2] - 1]]) for key, r in out.items()}


def report(spark, docs, labels):
    rows = filter_audit.orders(filter_audit.masks(docs, labels)).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}


def planted():
    long_ = " ".join(f"w{i}" for i in range(120))
    rows = [(i, long_, "en") for i in (7, 3, 9, 9)] + [(1, "SHOUT SHOUT", "en"), (2, "a # b", None), (4, "", ""), (5, None, None), (6, "word " * 150, "de"), (8, long_ + " $", "de")]
    rows += [(None, long_, "en"), (None, None, None), (10, "x" * 50_000, "fr"), (11, long_, "fr"), (12, ("AB " * 60 + "c d ") * 2, "en"), (12, "other", "en"), (2**40, "a # b", "fr")]
    labels = [(3, 1, 0), (7, None, 1), (7, 1, None), (9, 0, 1), (None, 1, 1), (1, 1, 1), (99, 1, 1), (4, None, None), (11, 1, 0), (2**40, 1, 1)]
    return rows, labels


def test_equals_every_order_run_one_by_one(spark):
    rows, labels = planted()
    docs = spark.createDataFrame([(d, t, "zz", 5, p) for d, t, p in rows], "doc_id long, text string, mask string, n int, lang string").repartition(5)
    got = report(spark, docs, spark.createDataFrame(labels, LABELS))
    assert got == model(rows, labels)


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert report(spark, odd, spark.createDataFrame([(1, 1, 1)], LABELS)) == model(rows, [(1, 1, 1)])


def test_empty_table_has_no_parts(spark, empty):
    assert report(spark, empty, spark.createDataFrame([], LABELS)) == {}


def test_sql_gives_the_same(spark):
    rows, labels = planted()
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert {tuple(r[:3]): tuple(r[3:]) for r in c.execute(filter_audit.SQL).fetchall()} == model(rows, labels)


@pytest.mark.parametrize("text", [None, "", " \t\n"])
def test_texts_without_words_fail_a_alone(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(filter_audit.text_mask(F.col("t")).alias("m")).first()["m"]
    assert got == 1
