"""From the linear-time dialect of regular expressions, which users write, to Java's, which Spark runs.

The dialect has Unicode classes by category, script or property, sets with nesting, intersection and differences, named and
flagged groups, and no look-around, back-references or possessive repeats. A pattern is read into Java's syntax piece by
piece, so what means something else there is rewritten and what is invalid here is refused, wherever it stands: a repeat of
a repeat, for one, is wrapped, as Java would take its second sign for possessive.
"""

from __future__ import annotations

import functools
import re

# Long names of general categories.
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
# Properties that both sides know, and those that are ranges.
PROPERTIES = {"alphabetic": "IsAlphabetic", "alpha": "IsAlphabetic", "ideographic": "IsIdeographic", "lowercase": "IsLowercase", "lower": "IsLowercase", "uppercase": "IsUppercase", "upper": "IsUppercase", "whitespace": "IsWhite_Space", "wspace": "IsWhite_Space", "space": "IsWhite_Space", "hexdigit": "IsHex_Digit", "joincontrol": "IsJoin_Control", "noncharactercodepoint": "IsNoncharacter_Code_Point", "emoji": "IsEmoji", "assigned": "IsAssigned"}
EVERY = r"\x{0}-\x{10FFFF}"
# The ASCII classes in brackets.
ASCII = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_CONTROLS = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
#: How deep groups and sets may nest, and how often the bounded repeats around a piece may multiply it.
DEPTH, COPIES = 100, 1_000_000
_NAME = re.compile(r"[^\W\d][\w.\[\]]*")


class Invalid(ValueError):
    """The pattern isn't of the dialect."""


def translated(pattern: str) -> str:
    return _Reader(pattern).whole()


def _char(c: str) -> str:
    return c if c.isalnum() or c in "_ \"'<>,;:=!%@/`" or ord(c) > 0xA0 else f"\\x{{{ord(c):X}}}"


@functools.cache
def _property(name: str) -> tuple[str, bool]:
    """(the inside of a Java set, whether it is to be negated) for what stands in the braces of a class."""
    negated = name.startswith("^")
    key, sign, value = re.match(r"([^=:!]*)(!=|=|:)?(.*)\Z", name.removeprefix("^"), re.S).groups()
    if sign:
        negated ^= sign == "!="
        kind = _loose(key)
        if kind in ("gc", "generalcategory"):
            found = _category(_loose(value))
        elif kind in ("sc", "script", "scx", "scriptextensions"):
            found = _script(value)
        else:
            raise Invalid(name)
        if found is None:
            raise Invalid(name)
        return found, negated
    loose = _loose(key)
    for found in ({"any": EVERY, "ascii": r"\x00-\x7F"}.get(loose), _category(loose), f"\\p{{{PROPERTIES[loose]}}}" if loose in PROPERTIES else None, _script(key)):
        if found:
            return found, negated
    raise Invalid(name)


def _loose(name: str) -> str:
    loose = re.sub(r"[\s_-]", "", name).lower()
    return loose[2:] if loose.startswith("is") and len(loose) > 2 else loose


def _category(loose: str) -> str | None:
    short = CATEGORIES.get(loose) or next((c for c in CATEGORIES.values() if c.lower() == loose), None)
    return f"\\p{{{short}}}" if short else None


def _script(name: str) -> str | None:
    """A script's name as Java has it; whether there is such a script, regex's tables of Unicode know."""
    import regex

    tidy = re.sub(r"[\s-]+", "_", name.strip())
    if not re.fullmatch(r"[A-Za-z_]+", tidy):
        return None
    try:
        regex.compile(f"\\p{{Script={tidy}}}")
    except regex.error:
        return None
    return f"\\p{{Is{tidy}}}"


class _Set:
    """A class: the inside of a plain Java set, or an expression for one character where Java has no such set."""

    def __init__(self, inside: str = "", negated: bool = False, one: str | None = None):
        self.inside, self.negated, self.one = inside, negated, one

    def __str__(self) -> str:
        if self.one is not None:
            return f"(?:(?!{self.one})(?s:.))" if self.negated else self.one
        if not self.inside:
            return "(?s:.)" if self.negated else "(?!)"
        return f"[{'^' * self.negated}{self.inside}]"


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.at, self.depth, self.names = pattern, 0, 0, set()
        self.flags = {"m": False, "s": False, "U": False, "x": False, "u": True}

    def whole(self) -> str:
        out, _ = self.alternatives()
        if self.at < len(self.p):
            raise Invalid("a bracket too many")
        return out

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.p):
            raise Invalid("the pattern ends too soon")
        self.at += 1
        return self.p[self.at - 1]

    def blank(self) -> None:
        """With the flag x, white space and comments are nothing."""
        while self.flags["x"] and (c := self.peek()) and (c.isspace() or c == "#"):
            if c == "#":
                end = self.p.find("\n", self.at)
                self.at = len(self.p) if end < 0 else end
            else:
                self.at += 1

    def alternatives(self) -> tuple[str, int]:
        """Up to the end or a closing bracket: the Java pattern, and the most copies that its repeats make of a piece."""
        self.depth += 1
        if self.depth > DEPTH:
            raise Invalid("nested too deep")
        out, copies = [], 1
        while True:
            self.blank()
            c = self.peek()
            if not c or c == ")":
                break
            if c == "|":
                self.at += 1
                out.append("|")
                continue
            piece, n, repeatable = self.piece()
            piece, n = self.repeated(piece, n, repeatable)
            if n > COPIES:
                raise Invalid("too many repeats")
            out.append(piece)
            copies = max(copies, n)
        self.depth -= 1
        return "".join(out), copies

    def repeated(self, piece: str, copies: int, repeatable: bool) -> tuple[str, int]:
        first = True
        while True:
            self.blank()
            c = self.peek()
            if c not in ("*", "+", "?", "{") or not c:
                return piece, copies
            if not repeatable:
                raise Invalid("nothing to repeat")
            self.at += 1
            if c == "{":
                m = re.compile(r"\s*(\d+)\s*(?:(,)\s*(\d*)\s*)?\}").match(self.p, self.at)
                if not m or (m[3] and int(m[3]) < int(m[1])):
                    raise Invalid("not a number of repeats")
                self.at = m.end()
                c = "{" + m[1] + (m[2] or "") + (m[3] or "") + "}"
                copies *= max(1, int(m[3] or m[1]))
            lazy = self.peek() == "?"
            self.at += lazy
            piece = (piece if first else f"(?:{piece})") + c + "?" * (lazy != self.flags["U"])
            first = False

    def piece(self) -> tuple[str, int, bool]:
        """The next piece, how often its repeats copy anything, and whether it may be repeated."""
        c = self.take()
        if c == "(":
            return self.group()
        if c in "*+?":
            raise Invalid("nothing to repeat")
        if c == "{":
            raise Invalid("nothing to repeat")
        if c == "[":
            return str(self.set()), 1, True
        if c == ".":
            return "(?s:.)" if self.flags["s"] else "[^\\n]", 1, True
        if c == "^":
            return r"(?:\A|(?<=\n))" if self.flags["m"] else r"\A", 1, True
        if c == "$":
            return r"(?=\n|\z)" if self.flags["m"] else r"\z", 1, True
        if c != "\\":
            return _char(c), 1, True
        return self.escaped(), 1, True

    def group(self) -> tuple[str, int, bool]:
        if self.peek() != "?":
            return self.rest_of_group("(?:")
        self.at += 1
        for opening in ("P<", "<"):
            if self.peek(len(opening)) == opening:
                if self.peek(2) in ("<=", "<!"):
                    raise Invalid("look-around")
                m = _NAME.match(self.p, self.at + len(opening))
                if not m or self.p[m.end() : m.end() + 1] != ">" or m[0] in self.names:
                    raise Invalid("a group's name")
                self.names.add(m[0])
                self.at = m.end() + 1
                return self.rest_of_group("(?:")
        m = re.compile(r"([imsxUu]*)(?:-([imsxUu]+))?([:)])").match(self.p, self.at)
        if not m or (m[3] == ")" and not (m[1] or m[2])) or len(set(m[1] + (m[2] or ""))) < len(m[1] + (m[2] or "")):
            raise Invalid("flags")
        self.at = m.end()
        before = dict(self.flags)
        self.flags |= dict.fromkeys(m[1].replace("i", ""), True) | dict.fromkeys((m[2] or "").replace("i", ""), False)
        case = "i" if "i" in m[1] else "-i" if "i" in (m[2] or "") else ""
        if m[3] == ")":
            return f"(?{case})" if case else "", 1, False
        out = self.rest_of_group(f"(?{case}:")
        self.flags = before
        return out

    def rest_of_group(self, opening: str) -> tuple[str, int, bool]:
        before = dict(self.flags)
        inner, copies = self.alternatives()
        if self.take() != ")":
            raise Invalid("a group without an end")
        self.flags = before
        return f"{opening}{inner})", copies, True

    def escaped(self) -> str:
        c = self.peek()
        if c and c in "bB<>":
            self.at += 1
            start, end = r"(?:\b(?=\w))", r"(?:\b(?<=\w))"
            m = re.compile(r"\{(start|end|start-half|end-half)\}").match(self.p, self.at) if c == "b" else None
            if m:
                self.at = m.end()
                return {"start": start, "end": end, "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}[m[1]]
            return {"<": start, ">": end}.get(c) or (f"\\{c}" if self.flags["u"] else f"(?-U:\\{c})")
        if c and c in "Az":
            self.at += 1
            return f"\\{c}"
        one = self.escape()
        return str(one) if isinstance(one, _Set) else _char(one)

    def escape(self) -> _Set | str:
        """What follows a backslash, in a set or outside: a class, or a character."""
        c = self.take()
        if c in "dswDSW":
            low = c.lower()
            if self.flags["u"]:
                return _Set(f"\\{low}", c != low)
            return _Set(ASCII[{"d": "digit", "s": "space", "w": "word"}[low]], c != low)
        if c in "pP":
            name = self.take()
            if name == "{":
                end = self.p.find("}", self.at)
                if end < 0:
                    raise Invalid("a class without an end")
                name, self.at = self.p[self.at : end], end + 1
            inside, negated = _property(name)
            return _Set(inside, negated ^ (c == "P"))
        if c in _CONTROLS:
            return chr(_CONTROLS[c])
        if c in "xuU":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{%d})" % {"x": 2, "u": 4, "U": 8}[c]).match(self.p, self.at)
            code = int(m[1] or m[2], 16) if m else -1
            if not 0 <= code < 0x110000 or 0xD800 <= code < 0xE000:
                raise Invalid("a character's number")
            self.at = m.end()
            return chr(code)
        if c.isascii() and not c.isalnum() and c not in "<>":
            return c
        raise Invalid(f"\\{c}")

    def set(self) -> _Set:
        """A set in brackets, after the opening one."""
        self.depth += 1
        if self.depth > DEPTH:
            raise Invalid("nested too deep")
        self.blank()
        negated = self.peek() == "^"
        self.at += negated
        plain, complex_ = [], []
        self.blank()
        while self.peek() == "-":  # signs at the beginning are themselves, and so is a bracket before anything else
            plain.append(_char(self.take()))
            self.blank()
        left, operator = None, None
        first = True

        def union() -> _Set:
            if not complex_:
                return _Set("".join(plain))
            return _Set(one="(?:" + "|".join([*([f"[{''.join(plain)}]"] if plain else []), *map(str, complex_)]) + ")")

        while True:
            self.blank()
            if first and not plain and self.peek() == "]":
                item: _Set | str = self.take()
            elif self.peek() == "]":
                self.at += 1
                break
            elif self.peek(2) in ("&&", "--", "~~"):
                sign = self.peek(2)
                self.at += 2
                left = _combined(left, operator, union())
                operator, plain, complex_ = sign, [], []
                continue
            elif self.peek() == "[":
                m = re.compile(r"\[:(\^?)([a-z]+):\]").match(self.p, self.at)
                if m and m[2] in ASCII:
                    self.at = m.end()
                    item = _Set(ASCII[m[2]], bool(m[1]))
                else:
                    self.at += 1
                    item = self.set()
            elif self.peek() == "\\":
                self.at += 1
                item = self.escape()
            else:
                item = self.take()
            first = False
            self.blank()
            if self.peek() == "-" and self.peek(2) not in ("--", "-]"):
                self.at += 1
                self.blank()
                if isinstance(item, _Set) or self.peek() == "[":
                    raise Invalid("a range of sets")
                end = self.take()
                end = self.escape() if end == "\\" else end
                if isinstance(end, _Set) or ord(end) < ord(item):
                    raise Invalid("a range")
                plain.append(f"{_char(item)}-{_char(end)}")
            elif isinstance(item, str):
                plain.append(_char(item))
            elif item.one is None and not item.negated:
                plain.append(item.inside)
            elif item.one is None and re.fullmatch(r"\\[dsw]", item.inside):
                plain.append(item.inside.upper())
            elif item.one is None and re.fullmatch(r"\\p\{\w+\}", item.inside):
                plain.append("\\P" + item.inside[2:])
            else:
                complex_.append(item)
        self.depth -= 1
        out = _combined(left, operator, union())
        return _Set(out.inside, negated ^ out.negated, out.one)


def _combined(left: _Set | None, operator: str | None, right: _Set) -> _Set:
    if left is None:
        return right
    a, b = str(left), str(right)
    return _Set(one={"&&": f"(?:(?={a}){b})", "--": f"(?:(?!{b}){a})", "~~": f"(?:(?!{b}){a}|(?!{a}){b})"}[operator])
