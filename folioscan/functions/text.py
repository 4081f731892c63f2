"""Normalisation and string similarity as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscan.functions.patterns import VARIANT_CLASSES

ALNUM = r"\p{IsAlphabetic}\p{N}"
# the characters that fold to the first of their class
_FOLD_FROM = "".join(c for group in VARIANT_CLASSES for c in group[1:])
_FOLD_TO = "".join(group[0] for group in VARIANT_CLASSES for _ in group[1:])


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, for which Spark has no function."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def _folded(c: Column) -> Column:
    # ASCII decomposes to itself, so that only other texts go to Python; lower-casing goes letter by letter, without the final sigma of a word
    decomposed = F.coalesce(nfkd(F.when(~c.rlike(r"\A\p{ASCII}*\z"), c)), c)
    return F.regexp_replace(F.lower(decomposed), "ς", "σ")


def normalised(c: Column, variants: bool = True) -> Column:
    """Decomposed, lower case, variants folded, letters and numbers only."""
    low = _folded(c)
    low = F.translate(low, _FOLD_FROM, _FOLD_TO) if variants else low
    return F.regexp_replace(low, f"[^{ALNUM}]", "")


def normalised_spaces(c: Column) -> Column:
    """Decomposed, lower case, anything else than letters and numbers is one space."""
    return F.trim(F.regexp_replace(_folded(c), f"[^{ALNUM}]+", " "))


def fold_ascii(c: Column) -> Column:
    """Decomposed, lower case, letters, numbers and white space."""
    return F.regexp_replace(_folded(c), rf"(?U)[^{ALNUM}\s]", "")


def _low(s: str) -> str:
    return "".join(c.lower() for c in unicodedata.normalize("NFKD", s)).replace("ς", "σ")


def python_normalised(s: str, variants: bool = True) -> str:
    """normalised() for literals on the driver."""
    import regex

    low = _low(s)
    low = low.translate(str.maketrans(_FOLD_FROM, _FOLD_TO)) if variants else low
    return regex.sub(r"[^\p{Alphabetic}\p{N}]", "", low)


def python_normalised_spaces(s: str) -> str:
    import regex

    low = _low(s)
    return regex.sub(r"[^\p{Alphabetic}\p{N}]+", " ", low).strip()


def token_set(spaced: Column) -> Column:
    """Distinct tokens of a text in normalised_spaces form."""
    return F.array_remove(F.array_distinct(F.split(spaced, " ")), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_bigrams(c: Column) -> Column:
    """Distinct pairs of adjacent UTF-8 bytes, in hexadecimal."""
    pairs = let(F.hex(F.encode(c, "utf-8")), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(h) / 2 - 2, F.lit(0)).cast("int")), lambda i: F.substring(h, 2 * i + 1, F.lit(4))))
    return F.when(F.octet_length(c) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _ratio(a: Column, b: Column) -> Column:
    def of(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"])).cast("double")
        return let(F.struct(both.alias("both"), (F.size(x["a"]) + F.size(x["b"]) - both).alias("all")), lambda y: F.when(y["all"] > 0, y["both"] / y["all"]).otherwise(F.lit(0.0)))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def byte_jaccard(a: Column, b: Column) -> Column:
    return _ratio(byte_bigrams(a), byte_bigrams(b))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _ratio(a, b)).otherwise(F.lit(0.0))


def is_subsequence(text: Column, pattern: Column) -> Column:
    """Whether pattern's characters occur in text in their order."""
    left = F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), pattern, lambda rest, c: F.when((rest != "") & rest.startswith(c) & (c != ""), F.substring(rest, 2, 1 << 30)).otherwise(rest))
    return left == ""


def contains_in_order(text: Column, literal: str) -> Column:
    """is_subsequence() of a literal, by a linear pattern."""
    from folioscan.functions.patterns import escape

    return F.lit(True) if not literal else text.rlike("(?s)^" + "".join(f"[^{escape(c)}]*{escape(c)}" for c in literal))


CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"


def cjk_ratio(c: Column) -> Column:
    total = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    return F.when(total > 0, F.regexp_count(c, F.lit(CJK)) / total).otherwise(F.lit(0.0))


def is_collection_title(c: Column) -> Column:
    return normalised(c).rlike("tripitaka|taisho|canon")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    """Lines without carriage returns; a newline at the end starts no line, and an empty text has none."""
    body = F.regexp_replace(c, r"\r?\n\z", "")
    split = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(split)


def squash_newlines(c: Column, most: int = 2) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r", ""), "\n{%d,}" % (most + 1), "\n" * most)


def plain_lines(c: Column) -> Column:
    """Every line trimmed and its white space collapsed, at most two newlines on end, none around."""
    each = F.transform(F.split(F.regexp_replace(c, "\r", ""), "\n", -1), collapse_spaces)
    return F.regexp_replace(squash_newlines(F.array_join(each, "\n")), r"^\n+|\n+\z", "")


def trimmed_lines(c: Column) -> Column:
    """Every line trimmed; three newlines or more become two."""
    each = F.transform(F.split(F.regexp_replace(c, "\r", ""), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))
    return F.regexp_replace(F.array_join(each, "\n"), "\n{3,}", "\n\n")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit(""))


def numbers(c: Column, most: int = 2) -> Column:
    return F.slice(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), 1, most)


_ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999, else the decimal number."""
    out, rest = F.lit(""), n
    for value, sign in _ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n.between(1, 3999), out).otherwise(n.cast("string"))


# Letters with marks in Pali titles and how they are written without.
_PALI_LETTERS = {"ā": "aa", "ī": "ii", "ū": "uu", "ṅ": "ng", "ñ": "ny", "ṭ": "t", "ḍ": "d", "ṇ": "n", "ḷ": "l", "ṃ": "m", "ṁ": "m"}


#: The same for str.translate().
PALI_LETTERS = str.maketrans(_PALI_LETTERS)


def title_variants(c: Column) -> Column:
    """The trimmed title, folded, in letters without marks, with sutta as suttanta, and that folded; none of a blank title."""
    base = F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    low = F.lower(base)
    for letter, written in _PALI_LETTERS.items():
        low = F.replace(low, F.lit(letter), F.lit(written))
    longer = F.replace(base, F.lit("sutta"), F.lit("suttanta"))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.array(base, fold_ascii(base), low, longer, fold_ascii(longer)))


def detect_source(identifier: Column) -> Column:
    """The corpus that an identifier's shape belongs to; null if none."""
    i = F.trim(identifier)
    up = F.upper(i)
    return (
        F.when(up.rlike("^T[0-9]"), "cbeta").when(up.rlike("^(DN|MN|SN|AN|KN)[0-9]"), "tipitaka").when(i.contains(".mul"), "tipitaka")
        .when(up.rlike("^J[0-9]{2}_"), "jozen").when(i.startswith("sa_"), "gretil").when(i.contains(",") & i.rlike("^[0-9,]+$"), "sat")
    )


def looks_like_ewts(c: Column) -> Column:
    """ASCII only, with two letters at least."""
    t = F.trim(c)
    return t.rlike(r"^\p{ASCII}*$") & (F.regexp_count(t, F.lit("[A-Za-z]")) >= 2)


def is_text_number(c: Column) -> Column:
    return F.trim(c).rlike("^[A-Za-z][0-9]{4}$")


def query_parameter(url: Column, key: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def t_number(start_id: Column) -> Column:
    """T and what precedes the first comma; null if that is empty."""
    first = F.trim(F.split_part(start_id, F.lit(","), F.lit(1)))
    return F.when(first != "", F.concat(F.lit("T"), first))


def ensure_fields(given: str, required: list[str]) -> list[str]:
    fields = [f.strip() for f in given.split(",") if f.strip()]
    return fields + [f for f in required if f not in fields]


def escape_phrase(query: str, exact: bool) -> str:
    safe = query.replace("\\", "\\\\").replace('"', '\\"')
    return f'"{safe}"' if exact else safe
