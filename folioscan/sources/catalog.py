"""Catalogues of a corpus: a row per file with id, title, path and a map of metadata."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as T
from folioscan.functions.markup import events, nested_heads

INDEX = "id string, title string, path string, meta map<string,string>"
# What an index says of its corpus's version.
VERSIONS = {"sarit": "sarit_index_v1", "muktabodha": "muktabodha_index_v1", "cbeta": "cbeta_index_v2", "tipitaka": "tipitaka_index_v2"}
#: What is asked of a stored index, by corpus: of so many first entries the existing path and, where there is one, the version;
#: of so many that they have a preview of headings; of so many of two collections that an alias is composite.
CHECKED, PREVIEWED, COMPOSITE = 10, {"tipitaka": 20}, {"tipitaka": 50}
VERSIONED = ("cbeta", "tipitaka")
#: Headings whose forms are aliases.
ALIASED = 6
#: Elements that are read of a file, by corpus; others are read until id and title are known, as the reference does.
EVENTS = {"sarit": 80_000, "muktabodha": 60_000, "gretil": 50_000, "cbeta": 50_000, "tipitaka": 12_000}
#: Elements whose text is read, however deep it lies in them.
_READ = {"title", "author", "editor", "publisher", "date", "idno", "resp", "name", "persName", "head", "term", "classCode", "p"}
_TRANSLATOR = re.compile(r"transl|trl|\btr\.|譯|译", re.I)
_COLLECTION = re.compile("tripitaka|taisho|canon")
# Collections and the prefix of their identifiers.
NIKAYAS = [("digha", "DN"), ("majjhima", "MN"), ("samyutta", "SN"), ("anguttara", "AN"), ("agguttara", "AN"), ("khuddaka", "KN")]


def _cjk(text: str) -> float:
    solid = [c for c in text if not c.isspace()]
    return sum("一" <= c <= "鿿" or "㐀" <= c <= "䶿" for c in solid) / len(solid) if solid else 0.0


def title_rank(text: str, lang: str | None, level: str | None) -> float:
    """How well a header title names its text: Chinese and Japanese first, the work rather than the series."""
    score = 0.0
    if lang is not None:
        score += 3.0 if lang.lower().startswith("zh") else 2.0 if lang.lower().startswith("ja") else 0.5
    score += 2 * _cjk(text) + {"m": 5.0, "s": -5.0}.get(level or "", 0.0)
    folded = "".join(c for c in unicodedata.normalize("NFKD", text).lower() if c.isalnum())
    return score - 2.0 * bool(_COLLECTION.search(folded)) + min(len(text), 30) / 100


def best_title(candidates: list[tuple[str, str | None, str | None]]) -> str | None:
    kept = [c for c in candidates if c[0].strip()]
    return max(kept, key=lambda c: title_rank(*c))[0] if kept else None  # max keeps the first


def title_rank_column(text: Column, lang: Column, level: Column) -> Column:
    """title_rank() as an expression."""
    low = F.lower(lang)
    score = F.when(lang.isNull(), 0.0).when(low.startswith("zh"), 3.0).when(low.startswith("ja"), 2.0).otherwise(0.5)
    score = score + 2 * T.cjk_ratio(text) + F.when(level == "m", 5.0).when(level == "s", -5.0).otherwise(0.0)
    return score - F.when(T.is_collection_title(text), 2.0).otherwise(0.0) + F.least(F.length(text), F.lit(30)) / 100


def read_header(xml: str, most: int | None) -> dict:
    """Of a file's first events, or of those up to the first id and title: ids, titles, contributors, responsibilities, heads, keywords, divisions, rendered paragraphs."""
    found: dict = {"id": None, "titles": [], "author": [], "editor": [], "publisher": [], "date": [], "idno": [], "resp": [], "heads": [], "keywords": [], "classCode": [], "catRef": [], "rend": {}, "div": [], "juan": 0}
    stack: list[tuple[str, dict, list[str]]] = []
    inside = lambda n: any(s[0] == n for s in stack)
    role: list[str] = []
    for i, (kind, name, at) in enumerate(events(xml)):
        if i >= most if most is not None else found["id"] and found["titles"]:
            break
        if kind in ("start", "empty"):
            found["id"] = found["id"] or at.get("xml:id")
            if name == "juan" and at.get("fun", "").lower() == "open":
                found["juan"] += 1
            if name == "div" and at.get("n") and len(found["div"]) < 64:
                found["div"].append((at["n"], at.get("type", "")))
            if name == "catRef" and at.get("target"):
                found["catRef"].append(at["target"])
        if kind == "start":
            stack.append((name, at, []))
        elif kind == "text":
            for s in stack:
                if s[0] in _READ:
                    s[2].append(name)
        elif kind == "end" and any(s[0] == name for s in stack):
            while stack:
                tag, attributes, parts = stack.pop()
                text = " ".join("".join(parts).split())
                if text:
                    if tag == "title" and inside("titleStmt"):
                        found["titles"].append((text, attributes.get("xml:lang"), attributes.get("level"), attributes.get("type")))
                    elif tag in ("author", "editor") and inside("titleStmt"):
                        found[tag].append(text)
                    elif tag in ("publisher", "date", "idno") and inside("publicationStmt"):
                        found[tag].append(text)
                    elif tag == "resp":
                        role.append(text)
                    elif tag in ("name", "persName") and inside("respStmt"):
                        found["resp"].append((role[-1] if role else "", text))
                    elif tag == "head":
                        found["heads"].append(text)
                    elif tag == "term" and inside("keywords"):
                        found["keywords"].append(text)
                    elif tag == "classCode":
                        found["classCode"].append(text)
                    if tag in ("p", "head") and (rend := attributes.get("rend")):
                        values = found["rend"].setdefault(rend, [])
                        if text not in values and len(values) < 8:
                            values.append(text)
                if tag == name:
                    break
    return found


def _entry(corpus: str, path: str, xml: str | None) -> tuple[str, str, str, dict | None]:
    stem = re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])
    if xml is None:
        return stem, stem, path, None
    if corpus == "muktabodha" and path.endswith(".txt"):
        return stem, stem, path, {"indexVersion": VERSIONS[corpus], "ext": "txt"}
    h = read_header(xml, EVENTS.get(corpus))
    titles = [t[0] for t in h["titles"]]
    main = next((t[0] for t in h["titles"] if t[3] and "main" in t[3]), None)
    meta: dict[str, str | None] = {}
    if corpus == "plain":
        heads = nested_heads(xml)[:1]
        return h["id"] or stem, (titles + heads + [stem])[0], path, None
    if corpus == "sarit":
        meta = {"xmlId": h["id"], "author": next(iter(h["author"]), None), "editor": next(iter(h["editor"]), None), "indexVersion": VERSIONS[corpus]}
        return stem, main or (titles + [stem])[0], path, {k: v for k, v in meta.items() if v}
    if corpus == "muktabodha":
        return stem, (titles + [stem])[0], path, {"indexVersion": VERSIONS[corpus], "ext": "xml"}
    translators = [n for r, n in h["resp"] if _TRANSLATOR.search(r)]
    meta = {
        "author": "・".join(h["author"]), "editor": "・".join(h["editor"]), "translator": "・".join(translators), "publisher": next(iter(h["publisher"]), None),
        "date": next(iter(h["date"]), None), "idno": next(iter(h["idno"]), None), "headsPreview": " | ".join(h["heads"][:10]),
        "respAll": " | ".join(f"{r.lower() if corpus == 'gretil' else r}: {n}" for r, n in h["resp"]),
    }
    if corpus == "gretil":
        meta |= {"keywords": " | ".join(h["keywords"]), "classCode": " | ".join(h["classCode"]), "catRef": " | ".join(h["catRef"])}
        return stem, (main or (titles + [stem])[0])[:120], path, {k: v for k, v in meta.items() if v}
    if corpus == "cbeta":
        name, folders = path.rpartition("/")[2], [f for f in path.split("/")[:-1] if f]
        number = re.match("[0-9]+", name[at + 1 :]) if (at := name.lower().find("n")) >= 0 else None  # what follows the first n
        meta |= {"indexVersion": VERSIONS[corpus], "canon": folders[0] if folders else None, "nnum": number[0] if number else None, "juanCount": str(h["juan"]) if h["juan"] else None}
        title = best_title([t[:3] for t in h["titles"]]) or next(iter(h["heads"]), stem)
        return h["id"] or stem, title, path, {k: v for k, v in meta.items() if v}
    rend = {k: v[0] for k, v in h["rend"].items() if k in ("nikaya", "title", "subhead", "subsubhead", "book", "chapter")}
    title = " · ".join(rend[k] for k in ("nikaya", "book", "title", "subhead", "subsubhead", "chapter") if k in rend)
    every = {k: " | ".join(v) for k, v in h["rend"].items() if k in rend}
    meta = every | {"indexVersion": VERSIONS[corpus], "headsPreview": " | ".join(h["heads"][:10]), "sections": " | ".join(f"{n}({t})" for n, t in h["div"]), "section_types": " | ".join(t for _, t in h["div"])}
    title = title or (titles + [stem])[0]
    meta = {k: v for k, v in meta.items() if v or k == "headsPreview"} | aliases(every)
    if h["heads"]:
        meta["alias"] = " ".join(filter(None, [meta.get("alias"), *(v for t in [*h["heads"][:ALIASED], title] for v in title_forms(t))]))
    return stem, title, path, meta


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if c.isalnum() or c.isspace())


def _roman(n: int) -> str:
    out = ""
    for value, sign in T._ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def title_forms(title: str) -> list[str]:
    """T.title_variants() for titles that are at hand: itself, folded, in letters without marks, with the longer ending, and that folded."""
    base = title.strip()
    longer = base.replace("sutta", "suttanta")
    return [base, fold(base), base.lower().translate(T.PALI_LETTERS), longer, fold(longer)] if base else []


def aliases(meta: dict[str, str]) -> dict[str, str]:
    """alias and alias_prefix of a text of the five collections: its number in every usual form, of two collections also with a part's."""
    nikaya = fold(meta.get("nikaya", ""))
    prefix = next((p for name, p in NIKAYAS if name in nikaya), None)
    if prefix is None:
        return {}
    digits = [n for k in ("book", "title", "subhead", "subsubhead", "chapter") if k in meta for n in re.findall("[0-9]+", meta[k])]
    forms = [""]
    if digits:
        one = str(int(digits[0]))
        forms += [one, digits[0].zfill(2), digits[0].zfill(3), _roman(int(one)) if int(one) else "0"]
        if prefix in ("SN", "AN") and len(digits) > 1:
            two = str(int(digits[1]))
            forms += [f"{one}.{two}", f"{digits[0].zfill(2)}.{digits[1].zfill(2)}", f"{_roman(int(one)) if int(one) else 0}.{two}"]
    out = [f"{prefix}{gap}{form}" for form in forms for gap in (("", " ") if form else ("",))]
    return {"alias": " ".join(dict.fromkeys(x for form in out for x in (form, form.lower()))), "alias_prefix": prefix}


def build(texts: DataFrame, corpus: str, root: str = "") -> DataFrame:
    """texts (path, text) to INDEX; texts are read where they are, file by file. What a path says of its file is read below root."""
    root = root.rstrip("/") + "/" if root else ""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_entry(corpus, p.partition(root)[2] if root and root in p else p, x) for p, x in zip(b["path"], b["text"], strict=True)]
            yield pd.DataFrame([(i, t, p, m) for (i, t, _, m), p in zip(found, b["path"], strict=True)], columns=["id", "title", "path", "meta"])

    return texts.select("path", "text").mapInPandas(entries, INDEX)


def validity(index: DataFrame, existing: DataFrame, corpus: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """A row per stored index (of one corpus; told apart by the columns by): checked, sound (entries among the first ones whose
    path exists, with meta and version where the corpus has one) and valid, by the rules of the corpus.

    Of each index only its first entries are read, in the order of their paths. Lists of contents are no entries.
    """
    previewed, composite = PREVIEWED.get(corpus, 0), COMPOSITE.get(corpus, 0)
    most = max(CHECKED, previewed, composite)
    rows = index.filter(~F.col("path").endswith(".toc.xml")) if corpus == "tipitaka" else index
    if not by:
        rows = rows.orderBy("path").limit(most)
    first = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("path"))).filter(F.col("_at") <= most)
    there = first.join(existing.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    value = lambda k: F.col("meta")[k]
    sound = F.coalesce(F.col("_there"), F.lit(False))
    if corpus in VERSIONED:
        sound = sound & F.coalesce(value("indexVersion") == VERSIONS[corpus], F.lit(False))
    among = lambda n: F.col("_at") <= n
    lacks = (among(CHECKED) & ~sound) | (among(previewed) & F.coalesce(value("headsPreview").isNull(), F.lit(True)))
    lacks = lacks | (among(composite) & F.coalesce(value("alias_prefix").isin("SN", "AN") & ~F.coalesce(value("alias").contains("."), F.lit(False)), F.lit(False)))
    counts = there.groupBy(*by).agg(F.count_if(among(CHECKED)).alias("checked"), F.count_if(among(CHECKED) & sound).alias("sound"), F.count_if(lacks).alias("_lacks"))
    return counts.withColumn("valid", (F.col("checked") > 0) & (F.col("_lacks") == 0)).drop("_lacks")


def bibliography(xml: str | None, most: int = 10_000) -> dict[str, str]:
    """The first value of each rendered paragraph's kind, within the first events of a file."""
    return {} if xml is None else {k: v[0] for k, v in read_header(xml, most)["rend"].items()}
