"""URL filter: rules first, else logistic regression on hashed character n-grams (operator 7, native).

Host and path are cut from the url by pattern. Rules (host, path) fit a host and all its subdomains and the paths that
start with the rule's; the longest fitting rule decides. Urls without a rule are judged by a logistic regression on
hashed character n-grams of host and path: which buckets are present, from the md5 of the n-gram, with the weights as
one array literal in the plan. It is trained on the driver from the small labelled table labelled_urls.tsv beside this
module, whole urls of made-up hosts, by full-batch descent; the rounded weights are the same for every engine, so SQL can
repeat the verdicts. held_out_accuracy() measures the model on folds of the table that it isn't trained on.

Defined cases: null urls and urls without :// have an empty host and path, fit no rule, and get the model's verdict on
no n-grams; hosts and paths shorter than an n-gram have none; a very long url is read whole, and an n-gram counts once;
equal urls get equal verdicts, row by row; ties between rules can't occur (a rule is unique), and a score of 0 allows; an
empty table gives no rows. Columns called like the results are replaced, also the url's own; others are kept.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm import common

#: (verdict, host, path): fixed by the contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Buckets (a power of 16), n-gram lengths, descent steps, step size and L2 weight.
BUCKETS, SIZES, STEPS, RATE, L2 = 4096, (3, 4), 400, 2.0, 1e-3
#: The share of urls that is to be blocked where nothing speaks for or against it: the fixed intercept is its log odds.
PRIOR = 0.2
#: The columns that judge() gives beside the input's.
RESULTS = ("host", "path", "rule", "score", "verdict")


@functools.lru_cache(1)
def labelled() -> tuple[tuple[str, str, int], ...]:
    """(host, path, blocked) of the labelled urls."""
    rows = []
    with open(os.path.join(os.path.dirname(__file__), "labelled_urls.tsv"), encoding="utf-8") as f:
        for line in f:
            if not line.startswith("#"):
                label, url = line.rstrip("\n").split("\t")
                m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", url)
                rows.append((m[1].lower(), m[2], int(label)))
    return tuple(rows)


def _buckets(host: str, path: str) -> set[int]:
    digits = len(f"{BUCKETS - 1:x}")
    return {int(hashlib.md5(f"{tag}{text[i : i + n]}".encode()).hexdigest()[:digits], 16) for tag, text in (("h", host), ("p", path)) for n in SIZES for i in range(len(text) - n + 1)}


def train(rows: list[tuple[str, str, int]]) -> tuple[float, ...]:
    """BUCKETS weights and the intercept, rounded so that every engine reads the same numbers."""
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r[2] for r in rows], dtype=float)
    for i, (host, path, _) in enumerate(rows):
        x[i, list(_buckets(host, path))] = 1
    w, bias = np.zeros(BUCKETS), float(np.log(PRIOR / (1 - PRIOR)))
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        w -= RATE * (x.T @ error / len(rows) + L2 * w)
    return (*(round(float(v), 6) for v in w), round(bias, 6))


@functools.lru_cache(1)
def weights() -> tuple[float, ...]:
    return train(list(labelled()))


def held_out_accuracy(folds: int = 5) -> float:
    """Of models that were trained without the fold that they judge."""
    rows, right = labelled(), 0
    for k in range(folds):
        w = train([r for i, r in enumerate(rows) if i % folds != k])
        right += sum((sum(w[b] for b in _buckets(h, p)) + w[-1] > 0) == bool(y) for h, p, y in rows[k::folds])
    return right / len(rows)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(tag: str, text: Column) -> Column:
    """The n-grams of all SIZES. The characters are an array that lambdas look into, so that a url costs what it is long."""

    def of(chars: Column, n: int) -> Column:
        starts = F.slice(chars, 1, F.greatest(F.size(chars) - n + 1, F.lit(0)))
        return F.transform(starts, lambda c, i: F.concat(F.lit(tag), c, *[F.get(chars, i + k) for k in range(1, n)]))

    return F.flatten(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), lambda chars: F.concat(*[of(chars, n) for n in SIZES])))


def model_score(host: Column, path: Column) -> Column:
    """Log-odds of block, rounded to 6 places."""
    w = weights()
    digits = len(f"{BUCKETS - 1:x}")
    table = F.from_json(F.lit("[" + ",".join(map(repr, w[:-1])) + "]"), "array<double>")
    buckets = F.array_distinct(F.transform(F.concat(_grams("h", host), _grams("p", path)), lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, digits), 16, 10).cast("int")))
    return F.round(F.aggregate(buckets, F.lit(w[-1]), lambda acc, b: acc + F.get(table, b)), 6)


def judge(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with RESULTS; columns of these names are replaced."""
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row")
    parts = pages.select(row, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    scored = parts.select("*", rule.alias("rule"), verdict.alias("_verdict"), model_score(F.col("host"), F.col("path")).alias("score"))
    judged = scored.withColumn("verdict", F.coalesce("_verdict", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))))
    return judged.select(*[F.col(f"_row.`{c}`") for c in pages.columns if c not in RESULTS], *RESULTS)


def query(spark, sf_dir):
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "score", "verdict")


def sql() -> str:
    w = weights()
    digits = len(f"{BUCKETS - 1:x}")
    cases = lambda what: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if what == 'rule' else v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))
    grams = ", ".join(f"list_transform(range(1, greatest(length({c}) - {n} + 2, 1)::BIGINT), lambda i: '{t}' || substr({c}, i, {n}))" for t, c in (("h", "host"), ("p", "path")) for n in SIZES)
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), g AS (
  SELECT *, list_distinct(list_transform(flatten([{grams}]), lambda x: ('0x' || substr(md5(x), 1, {digits}))::INT)) AS buckets FROM u
), m AS (
  SELECT {list(w[:-1])!r}::DOUBLE[] AS w
), s AS (
  SELECT *, round({w[-1]!r} + coalesce(list_sum(list_transform(buckets, lambda b: m.w[b + 1])), 0), 6) AS score FROM g, m
)
SELECT page_id, host, path, CASE {cases("rule")} END AS rule, score, coalesce(CASE {cases("verdict")} END, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s
"""
