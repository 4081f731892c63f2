"""Patterns of the linear-time dialect, against an engine that has it (for what that knows), and by hand."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscan.functions.patterns import java_pattern
from folioscan.operators import search

TEXTS = ["", "a", "ab", "abc abc", "C++ code", "x1y22", "foo_bar baz", "AbC", "café naïve", "法華經 the lotus", "αβγ abg", "a.b*c", "tab\there", "(x) [y] {z}", "a-b&&c", "2024-05-06", "]^-\\", "aaa bbb", "ab　cd", "#tag"]
#: Both engines know these.
SHARED = [
    "a", "ab|c", "^a", "c$", r"\bcode\b", r"C\++", "a*", "a+b", "a?b", "(a|b)+", "(?:ab)+", "[a-c]+", "[^a-c ]+", "[]a]", "[^]a]", "[a-]", "[-a]", r"[\]^-]+", "a{2}", "a{2,}", "a{1,2}", "a+?b", "a*?", r"\d+", r"\d{2,4}", r"\w+", r"\W", r"\s", r"\S+",
    r"\p{Han}+", r"\p{L}+", r"\pL", r"\PL+", r"\p{Lu}", r"\p{Greek}", r"\p{Latin}+", r"\P{Han}", r"[\p{Han}a]+", r"[^\p{L}]+", r"\p{^Han}", r"\x{6CD5}", r"\x41", r"(?P<y>[0-9]+)", "(?<y>[0-9]+)", "(?i)abc", "(?i:a)b", "(?-i)C", "(?s).+", ".+", "(?U)a+", "(?U)a+?", r"\.b\*", r"\(x\)", r"\[y\]", r"\{z\}",
    "[[:alpha:]]+", "[[:^alpha:]]+", "[[:digit:][:punct:]]+", "[[:space:]]", r"\t", "", "()", "a|", "|b", "(a*)*", "(a|b|)+c", r"\A", r"\z", r"\Aab\z", r"a\-b", r"\&\&", "x*y?[0-9]", "(?:a(?:b(?:c)))", "a.c|a-b", "(?:)", "[a&b]", "[.]", r"[\d.]+", "[&]",
]
REFUSED = ["(?=a)", "(?!a)", "(?<=a)", "(?<!a)", r"(a)\1", "(?>a)", "*a", "+", "a{", "a{2", "a{3,1}", "{2}", "(", "a)", "[", "[a", "[]", "[z-a]", r"[\d-z]", r"\Q", r"\Z", r"\G", r"\h", r"\k<y>", "(?<y", "(?<1>a)", "(?P<y>a)(?P<y>b)", r"\p{Nope}", r"\p{", r"\x{110000}", r"\xG", "(?q)", "(?i", "a\\", r"\8", "(" * 300 + ")" * 300, "((a{1000}){1000}){1000}"]
#: What the other engine doesn't know: the pattern, texts with a match and texts without.
BY_HAND = [
    ("a**", ["", "b"], []), ("^(?:a++)$", ["aaa"], ["ab"]), (r"[a-z&&[^aeiou]]", ["b", "ab"], ["a", "1"]), ("^[a-z--[aeiou]]$", ["b"], ["a", "1"]), ("^[a-d~~c-f]$", ["a", "f"], ["c", "d", "z"]), ("^[a[0-9]]$", ["a", "5"], ["b"]),
    (r"^[^[^a-c]]$", ["b"], ["z"]), (r"^[\w&&\d]+$", ["12"], ["a1"]), ("(?x) a b # c\n c", ["abc"], ["a b c"]), (r"(?x)[ a b ]\ c", ["a c"], ["ac"]), (r"\p{Script=Greek}", ["α"], ["a"]), (r"\p{sc=Han}", ["法"], ["a"]), (r"\p{gc=Lu}(?-i)", ["A"], ["1"]),
    (r"\p{Uppercase_Letter}", ["A"], ["1"]), (r"\p{script!=Han}", ["a"], ["法"]), (r"\p{White_Space}", ["　"], ["a"]), (r"a\s+b", ["a　b"], ["ab"]), (r"^\w+$", ["café", "བོད"], ["a b"]), (r"\d", ["٣"], ["x"]), (r"(?-u)^\w+$", ["cafe"], ["café"]),
    (r"法|\U00006cd5|\u{6cd5}", ["法"], ["a"]), (r"\<code\>", ["a code b"], ["codes", "decode"]), (r"\b{start}b", ["a b"], ["ab"]), (r"b\b{end}", ["ab c"], ["abc"]), ("^[[:^digit:]&&[:alnum:]]$", ["a"], ["1", "-"]), (r"[\p{L}--\p{Latin}]", ["法"], ["a1"]), ("cafÉ", ["café"], ["cafe"]),
    (r"^[a&&]$", [], ["a"]), (r"^[--a]$", [], ["b"]), ("(?m)^b$", ["b"], ["ab"]), (r"^[^\p{Han}\s]+$", ["abc"], ["法", "a b"]),
]


def found(spark, patterns, texts):
    """{(pattern, text): the first match, or None}."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    out = {}
    for lo in range(0, len(patterns), 40):
        some = patterns[lo : lo + 40]
        cols = [F.when(F.col("t").rlike(j), F.regexp_extract("t", f"({j})", 1)) for j in map(java_pattern, some)]
        for r in rows.select("t", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect():
            out |= {(p, r["t"]): r[f"c{i}"] for i, p in enumerate(some)}
    return out


def known(patterns, texts):
    c = duckdb.connect()
    out = {}
    for p in patterns:
        for t in texts:
            q = p.replace("(?<y>", "(?P<y>")
            out[p, t] = c.execute("SELECT CASE WHEN regexp_matches($1, $2) THEN regexp_extract($1, $2, 1) END", [t, f"(?i)({q})"]).fetchone()[0]
    return out


def test_patterns_that_another_engine_has(spark):
    ascii_only = [p for p in SHARED if any(x in p for x in (r"\w", r"\W", r"\b", r"\d", r"\s", r"\S", "[:"))]
    plain = [t for t in TEXTS if t.isascii()]
    for patterns, texts in ((ascii_only, plain), ([p for p in SHARED if p not in ascii_only], TEXTS)):
        assert found(spark, patterns, texts) == known(patterns, texts)


def test_random_patterns(spark):
    rng = random.Random(11)

    def piece(depth):
        kind = rng.randrange(9 if depth else 6)
        if kind < 3:
            return rng.choice("abc")
        if kind == 3:
            return rng.choice(["[ab]", "[^a]", "[a-c]", ".", r"\p{L}", "[b-]", r"\x61", "[[:alpha:]]"])
        if kind < 6:
            return rng.choice(["a", "b", "[ab]", "[^a]", ".", "(?:ab)"]) + rng.choice(["*", "+", "?", "{2}", "{1,2}", "*?", "+?", "??"])
        inner = "|".join("".join(piece(depth - 1) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3)))
        return f"({rng.choice(['', '?:', '?i:'])}{inner})" + rng.choice(["", "*", "+", "?"])

    patterns = list(dict.fromkeys("".join(piece(2) for _ in range(rng.randrange(1, 4))) for _ in range(120)))
    texts = ["".join(rng.choice("abcABd-") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 8, 10, 12)]
    assert found(spark, patterns, texts) == known(patterns, texts)


def test_patterns_by_hand(spark):
    got = found(spark, [p for p, _, _ in BY_HAND], sorted({t for _, a, b in BY_HAND for t in a + b}))
    for p, yes, no in BY_HAND:
        assert [got[p, t] is not None for t in yes + no] == [True] * len(yes) + [False] * len(no), p


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    assert java_pattern(pattern) is None


@pytest.mark.parametrize("pattern", [r"\p{Han}+", r"\p{L}+", r"C\++", "(?<y>[0-9]+)", r"\x{4E00}", "(?P<y>[0-9]+)"])
def test_search_finds_them(spark, pattern):
    files = spark.createDataFrame([(1, "C++ 17\n一法"), (2, "-")], "doc_id int, text string")
    assert [r["doc_id"] for r in search.grep(files, pattern).collect()] == [1]
