"""Tibetan script from its Latin transliteration (the extended Wylie scheme).

A syllable is read as clusters of consonants, each with the vowel that follows it. A cluster is one stack if its letters may
stand on one another, else a prefix and a stack; a plus joins letters whatever they are, a full stop parts them. Consonants
without a vowel after them are suffixes, letter by letter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import text as T

# Consonants with the numbers of their letters, vowels, signs after them, and punctuation.
CONSONANTS = {
    "k": 0xF40, "kh": 0xF41, "g": 0xF42, "ng": 0xF44, "c": 0xF45, "ch": 0xF46, "j": 0xF47, "ny": 0xF49, "T": 0xF4A, "Th": 0xF4B, "D": 0xF4C, "N": 0xF4E, "t": 0xF4F, "th": 0xF50, "d": 0xF51, "n": 0xF53, "p": 0xF54, "ph": 0xF55, "b": 0xF56, "m": 0xF58,
    "ts": 0xF59, "tsh": 0xF5A, "dz": 0xF5B, "w": 0xF5D, "zh": 0xF5E, "z": 0xF5F, "'": 0xF60, "y": 0xF61, "r": 0xF62, "l": 0xF63, "sh": 0xF64, "Sh": 0xF65, "s": 0xF66, "h": 0xF67,
}
VOWELS = {"a": "", "A": "ཱ", "i": "ི", "I": "ཱི", "u": "ུ", "U": "ཱུ", "e": "ེ", "ai": "ཻ", "o": "ོ", "au": "ཽ", "-i": "ྀ", "-I": "ཱྀ"}
SIGNS = {"M": "ཾ", "~M`": "ྂ", "~M": "ྃ", "H": "ཿ", "?": "྄", "X": "༷", "~X": "༵", "&": "྅"}
PUNCTUATION = {"//": "།།", "/": "།", ";": "༏", "|": "༑", "!": "༈", ":": "༔", "=": "༴", "<": "༺", ">": "༻", "(": "༼", ")": "༽", "@": "༄", "#": "༅", "*": "༌", "_": " "}
# What may stand under a letter above, and below which letters a letter may stand.
ABOVE = {"r": "k g ng j ny t d n b m ts dz", "l": "k g ng c j t d p b h", "s": "k g ng ny t d n p b m ts"}
BELOW = {"y": "k kh g p ph b m", "r": "k kh g t th d p ph b m n s h sh", "l": "k g b z r s", "w": "k kh g c ny t d ts tsh zh z r l sh s h"}
_ABOVE, _BELOW = ({k: frozenset(v.split()) for k, v in table.items()} for table in (ABOVE, BELOW))
VOWEL_LETTER, SUBJOINED, SEPARATOR = 0xF68, 0x50, "་"

_either = lambda table: "|".join(map(re.escape, sorted(table, key=len, reverse=True)))
_TOKEN = re.compile(rf"\[(?P<kept>[^\]]*)\]|(?P<consonant>{_either(CONSONANTS)})(?P<joined>\+)?|(?P<vowel>{_either(VOWELS)})|(?P<sign>{_either(SIGNS)})|(?P<point>{_either(PUNCTUATION)})|(?P<digit>[0-9])|(?P<space>\s+)|(?P<parted>\.)|(?P<other>.)", re.S)


def _stands(letters: list[str]) -> bool:
    """Whether letters may stand on one another."""
    if len(letters) == 1:
        return True
    first, second, *rest = letters
    if second in _ABOVE.get(first, ()) and (not rest or _stands([second, *rest]) and second not in _ABOVE):
        return True
    if first in _BELOW.get(second, ()):
        return not rest or (rest == ["w"] and second in ("y", "r"))
    return False


def _stack(letters: list[str]) -> str:
    return "".join(chr(CONSONANTS[c] + SUBJOINED * (i > 0)) for i, c in enumerate(letters))


def _cluster(parts: list[tuple[str, bool]]) -> str:
    """Consonants (with whether each is joined to the next) before a vowel."""
    if any(joined for _, joined in parts):
        out, held = "", []
        for c, joined in parts:
            held.append(c)
            if not joined:
                out, held = out + _stack(held), []
        return out + (_stack(held) if held else "")
    letters = [c for c, _ in parts]
    for k in range(len(letters)):  # the fewest letters go before the stack
        if _stands(letters[k:]):
            return "".join(chr(CONSONANTS[c]) for c in letters[:k]) + _stack(letters[k:])
    return _stack(letters)


def to_script(text: str) -> str:
    """The Tibetan of a transliteration; what isn't one stays, and so does what is in square brackets."""
    out: list[str] = []
    held: list[tuple[str, bool]] = []
    voiced = pointed = False

    def end() -> None:
        if held:
            out.append(_cluster(held) if any(j for _, j in held) else "".join(chr(CONSONANTS[c]) for c, _ in held))
            held.clear()

    for m in _TOKEN.finditer(text):
        kind, piece = m.lastgroup if m.lastgroup != "joined" else "consonant", m[0]
        if kind == "consonant":
            held.append((m["consonant"], bool(m["joined"])))
        elif kind == "vowel":
            if held:
                out.append(_cluster(held))
                held.clear()
            elif not voiced or piece != "a":
                out.append(chr(VOWEL_LETTER))
            out.append(VOWELS[piece])
            voiced = True
        elif kind == "parted":
            end()
        else:
            end()
            voiced = kind == "sign" and voiced
            out.append({"kept": m["kept"], "sign": SIGNS.get(piece), "point": PUNCTUATION.get(piece), "digit": chr(0xF20 + ord(piece[0]) - 48), "space": " " if pointed else SEPARATOR}.get(kind, piece))
        pointed = kind in ("point", "kept", "other")
    end()
    return "".join(out)


def script(c: Column) -> Column:
    """to_script() of a column; null stays."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else to_script(x)), "string")(c)


def search_terms(query: Column) -> Column:
    """array: a query, and its script where it looks like a transliteration and differs."""
    latin = T.looks_like_ewts(query)
    return F.when(latin, F.array_distinct(F.array(query, F.coalesce(script(F.when(latin, query)), query)))).otherwise(F.array(query))
