"""Hits of online sources, parsed from stored answers. Nothing here goes to a network."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import markup
from folioscan.functions import text as T

RESULT_PAGE = "struct<total:int,displayed:int,pages:int,hits:array<struct<lineno:string,title:string,author:string,snippet:string,detail_url:string,image_url:string>>>"
DETAIL_PAGE = "struct<header:string,textno:string,prev:string,next:string,line_ids:array<string>,content:string>"
MOST_HITS, SNIPPET = 50, 240


def _number(text: str, pattern: str) -> int | None:
    m = re.search(pattern, text)
    return int(m[1].replace(",", "")) if m else None


def _href(node) -> str:
    return next((a.at.get("href", "") for a in node.all("a")), "")


def _lineno(href: str) -> str | None:
    m = re.search(r"[?&]lineno=([^&#]+)", href or "")
    return m[1] if m else None


def parse_results(page: str | None, base: str = "", most: int = MOST_HITS) -> dict | None:
    """A result page: totals, pages, and rows of five cells or more without header cells: line id, image, title, author, text."""
    if page is None:
        return None
    root = markup.page(page)
    counts = "".join(n.text() for n in root.all("p", class_="rlt1")[:1])
    pages = next((i.at.get("value", "") for f in root.all("form") if f.at.get("name") == "lastpage" for i in f.all("input") if i.at.get("name") == "page"), "")
    hits = []
    for table in root.all("table", class_="result_table"):
        for tr in table.all("tr"):
            cells = tr.all("td")
            if tr.all("th") or len(cells) < 5 or len(hits) >= most:
                continue
            detail, image = _href(cells[0]), _href(cells[1])
            name, title, author = (" ".join(cells[k].text().split()) for k in (0, 2, 3))
            lineno = name or _lineno(detail) or ""
            if lineno:
                detail, image = f"detail.php?lineno={lineno}", f"image.php?lineno={lineno}"
            snippet = "\n".join(" ".join(x.split()) for x in cells[4].text(breaks=True).split("\n")).strip()[:SNIPPET]
            join = lambda u: u if not u or "://" in u else base + u
            hits.append({"lineno": lineno, "title": title, "author": author, "snippet": snippet, "detail_url": join(detail), "image_url": join(image)})
    return {"total": _number(counts, r"全\s*([0-9,]+)\s*件"), "displayed": _number(counts, r"([0-9,]+)\s*件を表示"), "pages": int(pages) if pages.strip().isdigit() else None, "hits": hits}


def parse_detail(page: str | None) -> dict | None:
    if page is None:
        return None
    root = markup.page(page)
    header = "".join(n.text() for n in root.all("p", class_="sdt01")[:1]).strip().removesuffix("画像").strip()
    first = header.split()[0] if header.split() else ""
    side = lambda c: next((_lineno(a.at.get("href", "")) for a in root.all("a", class_=c)), None)
    ids, lines = [], []
    for table in root.all("table", class_="sd_table"):
        for tr in table.all("tr"):
            one, two = tr.all("td", class_="sd_td1"), tr.all("td", class_="sd_td2")
            name = "".join(one[0].text().split()).rstrip(":") if one else ""
            text = two[0].text().strip() if two else ""
            if name and text:
                ids.append(name)
                lines.append(f"[{name}] {text}")
    return {"header": header, "textno": first if re.fullmatch("[A-Za-z][0-9]{4}", first) else None, "prev": side("tnbn_prev"), "next": side("tnbn_next"), "line_ids": ids, "content": "\n".join(lines)}


def _results(pages: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(("total", "displayed", "pages", "hits"))
    return pd.DataFrame([parse_results(p) or none for p in pages], columns=list(none)).astype({"total": "Int64", "displayed": "Int64", "pages": "Int64"})


def _details(pages: pd.Series) -> pd.DataFrame:
    keys = ["header", "textno", "prev", "next", "line_ids", "content"]
    return pd.DataFrame([parse_detail(p) or dict.fromkeys(keys) for p in pages], columns=keys)


def result_page(pages: Column) -> Column:
    return F.pandas_udf(_results, RESULT_PAGE)(pages)


def detail_page(pages: Column) -> Column:
    return F.pandas_udf(_details, DETAIL_PAGE)(pages)


def json_first(json: Column, path: str) -> Column:
    """The value at a path, or the first element of an array there, as a string."""
    v = F.try_parse_json(json)
    first, scalar = F.try_variant_get(v, path + "[0]", "string"), F.try_variant_get(v, path, "string")
    return F.nullif(F.when(first.isNotNull(), first).when(~scalar.startswith("["), scalar), F.lit(""))


# Fixed value: where an archive's resources are.
RESOURCES = "http://purl.bdrc.io/resource/"
HITS = "hits struct<hits:array<struct<_id:string,_routing:string,_score:double,_source:struct<inRootInstance:array<string>,prefLabel_bo:array<string>>>>>"


def archive_id(c: Column) -> Column:
    """An archive's identifier without its prefix, its resource's address, blanks and slashes around it; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"\Abdr:", ""), rf"\A\Q{RESOURCES}\E", "")
    return F.nullif(F.regexp_replace(bare, r"\A/+|/+\z", ""), F.lit(""))


def archive_hits(answers: DataFrame, json: str) -> DataFrame:
    """Elasticsearch-like answers to hits: id from the root instance, else the routing, else what begins an id of its prefix."""
    hit = F.explode(F.from_json(F.col(json), HITS)["hits"]["hits"])
    h = answers.select(hit.alias("h"))
    prefix = archive_id(F.substring_index("h._id", "_", 1))
    found = F.coalesce(archive_id(F.get(F.col("h._source.inRootInstance"), F.lit(0))), archive_id(F.col("h._routing")), F.when(prefix.startswith("MW") & (F.octet_length(prefix) >= 4), prefix))
    return h.select(found.alias("id"), F.get(F.col("h._source.prefLabel_bo"), F.lit(0)).alias("title"), F.col("h._score").alias("score"))


def turtle_values(turtle: Column, predicate: str) -> Column:
    """Local names after a predicate's first place, up to the next semicolon, or without one to the next full stop."""
    rest = F.regexp_extract(turtle, rf"(?s)\Q{predicate}\E(.*)", 1)
    part = F.when(rest.contains(";"), F.substring_index(rest, ";", 1)).otherwise(F.substring_index(rest, ".", 1))
    words = F.filter(F.split(part, "[^A-Za-z0-9:_]"), lambda w: w.rlike(r"\Abdr:."))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 5, 1 << 30)))


def see_also(turtle: Column) -> Column:
    """Addresses that a description refers to, each once."""
    found = F.regexp_extract_all(turtle, F.lit(r'(?s)rdfs:seeAlso[^"]*"([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: u != ""))


# Fixed value: where repositories of texts are.
REPOSITORIES = "github.com/Openpecha-Data/"


def repository_name(address: Column) -> Column:
    """The name of a repository of texts; null for other addresses."""
    name = F.trim(F.regexp_extract(address, rf"\Q{REPOSITORIES}\E([^/#?]*)", 1))
    return F.nullif(F.regexp_replace(name, r"(\.git)+\z", ""), F.lit(""))


def strip_marks(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<mark>"), F.lit("")), F.lit("</mark>"), F.lit(""))


def page_hits(answers: DataFrame, json: str, most: int = 0, *keep: str) -> DataFrame:
    """Hits whose fields are values or arrays of them: score, title, kdb, sutra, pb, kind, snippet (without marks, cut to most)."""
    hit = F.posexplode(F.from_json(F.col(json), "hits struct<hits:array<string>>")["hits"]["hits"])
    h = answers.select(*keep, hit.alias("pos", "h"))
    field = lambda name: json_first(F.col("h"), f"$.fields.{name}")
    marked = [F.from_json("h", f"highlight struct<{k}:array<string>>")["highlight"][k] for k in ("text", "textWildcard")]
    joined = [F.nullif(F.array_join(m, ""), F.lit("")) for m in marked]
    single = [json_first(F.col("h"), f"$.highlight.{k}") for k in ("text", "textWildcard")]
    snippet = strip_marks(F.coalesce(*joined, *single, F.lit("")))
    score = F.coalesce(F.from_json("h", "_score double")["_score"], F.lit(0.0))
    return h.select(*keep, "pos", score.alias("score"), F.coalesce(field("tname"), field("cname"), F.lit("")).alias("title"), *[F.coalesce(field(k), F.lit("")).alias(k) for k in ("kdb", "sutra", "pb")], field("sutraType").alias("kind"), (F.substring(snippet, 1, most) if most else snippet).alias("snippet"))


def percent_encoded(c: Column) -> Column:
    """All but letters, digits and - . _ ~ as percent signs and bytes."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def reader_link(base: str, kdb: Column, sutra: Column, page: Column, kind: Column, highlight: Column) -> Column:
    """Where a hit of page_hits() is read, with what is to be marked there."""
    named = F.when(kind == "voltext", "voltext").otherwise("sutra")
    return F.concat(F.lit(base), F.lit("?kdb="), percent_encoded(kdb), F.lit("&"), named, F.lit("="), percent_encoded(sutra), F.lit("&page="), percent_encoded(page), F.lit("&highlight="), percent_encoded(highlight))


def page_lines(pages: Column) -> Column:
    """Stored pages (JSON array of pbName and text) to "name: text" lines, without markup, blank ones left out."""
    each = F.transform(F.from_json(pages, "array<struct<pbName:string,text:string>>"), lambda p: F.struct(F.coalesce(p["pbName"], F.lit("")).alias("pb"), T.collapse_spaces(F.regexp_replace(F.coalesce(p["text"], F.lit("")), "<[^>]*>", " ")).alias("text")))
    return F.array_join(F.transform(F.filter(each, lambda p: p["text"] != ""), lambda p: F.concat(p["pb"], F.lit(": "), p["text"])), "\n")


def snippet_text(answer: Column, languages: tuple[str, ...] = ("", "bo")) -> Column:
    """A snippet's lines: texts, and [text, language] pairs in one of the languages."""
    items = F.from_json(answer, "snippet array<string>")["snippet"]

    def line(item: Column) -> Column:
        pair = F.from_json(item, "array<string>")
        text, language = F.get(pair, F.lit(0)), F.coalesce(F.get(pair, F.lit(1)), F.lit(""))
        return F.when(item.startswith("["), F.when(language.isin(*languages), F.coalesce(text, F.lit("")))).otherwise(item)

    return F.trim(F.array_join(F.transform(items, line), "\n"))


def chunk_text(answer: Column) -> Column:
    """The texts of the chunks of an answer, or of an array of answers; empty without any."""
    kind = "struct<innerHits:struct<chunks:struct<hits:array<struct<sourceAsMap:struct<text_bo:string>>>>>>"
    roots = F.when(F.trim(answer).startswith("["), F.from_json(answer, f"array<{kind}>")).otherwise(F.array(F.from_json(answer, kind)))
    texts = F.flatten(F.transform(roots, lambda r: F.coalesce(F.transform(r["innerHits"]["chunks"]["hits"], lambda h: h["sourceAsMap"]["text_bo"]), F.array().cast("array<string>"))))
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


def backend_of(source: Column, identifier: Column, url: Column, kdb: Column, sutra: Column, page: Column) -> Column:
    """Which backend holds a text: as named, by a page's three parts, by the address, by an identifier; null if unknown."""
    return (
        F.when(source.isin("adarsha", "adarshah"), "adarsha").when(source.isin("buda", "bdrc", "openpecha"), "buda").when(kdb.isNotNull() & sutra.isNotNull() & page.isNotNull(), "adarsha")
        .when(url.contains("online.adarshah.org") | url.contains("api.adarshah.org"), "adarsha").when(identifier.isNotNull(), "buda")
    )


def archive_fetch(wanted: DataFrame, snippets: DataFrame, chunks: DataFrame, texts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """wanted (id) with text and method: chunks of the snippet's text, else the snippet, else the repository of that name, else
    the first repository that the description refers to; null where nothing has text.

    Stored answers: snippets (id, answer), chunks (ut, answer), texts (repository, text), descriptions (id, turtle), one row of
    each key. The chain is joins on keys and one coalesce.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    snip = snippets.select("id", F.coalesce(json_first(F.col("answer"), "$.ut"), F.lit("")).alias("ut"), blank(snippet_text(F.col("answer"))).alias("snippet"))
    chunk = chunks.select("ut", blank(chunk_text(F.col("answer"))).alias("chunk"))
    held = texts.select(F.col("repository").alias("_r"), blank(F.col("text")).alias("held"))
    ids = wanted.select("id").distinct()
    named = ids.filter(F.col("id").startswith("I") & ~F.col("id").startswith("IE")).join(held, F.col("id") == F.col("_r")).select("id", F.col("held").alias("own"))
    refs = descriptions.select("id", F.posexplode(see_also(F.col("turtle"))).alias("pos", "address")).withColumn("_r", repository_name(F.col("address")))
    referred = refs.join(held.filter("held IS NOT NULL"), "_r").groupBy("id").agg(F.min_by("held", "pos").alias("referred"))
    all_ = ids.join(snip, "id", "left").join(chunk, "ut", "left").join(named, "id", "left").join(referred, "id", "left")
    method = F.when(F.col("chunk").isNotNull(), "chunks").when(F.col("snippet").isNotNull(), "snippet").when(F.col("own").isNotNull() | F.col("referred").isNotNull(), "base")
    return all_.select("id", F.coalesce("chunk", "snippet", "own", "referred").alias("text"), method.alias("method"))


SEARCHED = "response struct<numFound:bigint,docs:array<struct<id:string,fascnm:string,startid:string,endid:string,body:string>>>"


def searched(answers: DataFrame, json: str, *keep: str) -> DataFrame:
    """Stored search answers to a row per document: pos, id, fascnm, startid, endid, body, t_number, and count, the answer's own."""
    r = answers.select(*keep, F.from_json(F.col(json), SEARCHED)["response"].alias("r"))
    docs = r.select(*keep, F.coalesce("r.numFound", F.lit(0)).alias("count"), F.posexplode("r.docs").alias("pos", "d")).select(*keep, "count", "pos", "d.*")
    return docs.withColumn("t_number", T.t_number(F.coalesce("startid", F.lit(""))))


def searched_titles(docs: DataFrame, query: str, rows: int, offset: int = 0, ask: int = 5) -> DataFrame:
    """Of the first ask * rows documents the titles that hold the query in normal form, each once, a page of them."""
    title = F.coalesce("fascnm", F.lit(""))
    held = docs.filter(F.col("pos") < max(rows * ask, rows)).withColumn("title", title).filter(T.normalised(F.col("title")).contains(T.python_normalised(query)))
    return held.groupBy("title").agg(F.min("pos").alias("pos")).orderBy("pos").offset(offset).limit(rows)


def detail_url(useid: Column, base: str) -> Column:
    """The address of a document's page: the join key of stored pages is cache_key() of it."""
    return F.concat(F.lit(base + "?mode=detail&ob=1&mode2=2&useid="), F.regexp_replace(F.url_encode(useid), r"\+", "%20"))


def base_text_paths(tree_json: Column, volume: str | None = None) -> Column:
    """Sorted paths of base texts in a repository's tree, of one volume if given."""
    paths = F.transform(F.from_json(tree_json, "tree array<struct<path:string>>")["tree"], lambda t: t["path"])
    kept = F.filter(paths, lambda p: p.contains(".opf/base/") & p.endswith(".txt") & (F.lit(True) if volume is None else p.contains(volume)))
    return F.array_sort(kept)


def language_pairs(pairs: Column, languages: tuple[str, ...] = ("", "bo")) -> Column:
    """Texts of [text, language] pairs in one of the languages, joined by newlines."""
    return F.array_join(F.transform(F.filter(pairs, lambda p: F.coalesce(F.get(p, F.lit(1)), F.lit("")).isin(*languages)), lambda p: F.get(p, F.lit(0))), "\n")


def paging(count: Column, rows: int, offset: int) -> Column:
    """What an answer shows: offset + 1 .. min(offset + rows, count)."""
    return F.concat(F.lit(str(offset + 1)), F.lit(".."), F.least(F.lit(offset + rows), count).cast("string"))


def display_line(start_id: Column, title: Column, useid: Column) -> Column:
    return F.concat_ws(" ", T.t_number(start_id), title, F.concat(F.lit("[useid: "), useid, F.lit("]")))


def cache_key(url: Column) -> Column:
    """Where the answer of a url is stored: the join key of a table of stored pages."""
    return F.sha1(url.cast("binary"))


#: Bytes from which a part of a page counts as its text.
ENOUGH = 50
# The places that are tried in turn, the first element of each.
PLACES = ("#text", "#viewer", "#content", "main", ".content", ".article", "#main", "#result", "#detail", "#sattext", "pre#text", "pre", ".text", "body")


def _first(root, place: str):
    """The first element of a tag, an id after # or a class after a dot."""
    m = re.fullmatch(r"(\w*)(?:([#.])(\w+))?", place)
    hit = lambda n: (not m[1] or n.tag == m[1]) and (not m[2] or m[3] == n.at.get("id") if m[2] != "." else m[3] in n.at.get("class", "").split())
    return next((n for n in root.walk() if isinstance(n, markup.Node) and n is not root and hit(n)), None)


def _lines(text: str) -> str:
    """Trimmed lines, at most one of them blank on end, none around."""
    each = "\n".join(x.strip() for x in text.replace("\r", "").split("\n"))
    return re.sub("\n{3,}", "\n\n", each).strip("\n")


def article_text(page: str | None) -> str | None:
    """Lines marked as text if they make up enough, else the first place that has enough, else nothing."""
    if page is None:
        return None
    root = markup.page(page)
    marked = _lines("\n".join(t for n in root.all("span", class_="tx") if (t := n.text().strip())))
    if len(marked.encode()) > ENOUGH:
        return marked
    for place in PLACES:
        if (node := _first(root, place)) is not None:
            text = _lines("\n".join(x for x in node.walk() if isinstance(x, str)))
            if len(text.encode()) > ENOUGH:
                return text
    return ""
