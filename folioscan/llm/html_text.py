"""Main text of HTML pages by tree scoring (operator 12).

A page becomes a tree of elements. What is never part of an article goes with all below it: by element (menus, sidebars,
footers, forms, scripts), by role, by the words of its class and id (adverts, notices, comments), or because it is hidden.
Each paragraph that is left, a block with text of its own, passes points for its length and commas to its parent, half of
them to the grandparent, a third of that to those above in turn; an element's score is discounted by its link density. The
best container is kept whole, or the article around it; so are siblings, of it and of what is around it, with a score of a
fifth of the best at least (a half, further out), and a heading before it. Within, only lists of links go, and blocks of
links where no article is marked.

Blocks are block elements, and text beside them; line breaks, cells' edges and other white space inside a block are one
space. Pages are read by one scan in time linear in their length, and trees are walked without recursion, so very long and
very deep pages are read whole; a task holds the tree of one page.

Defined cases: null and empty html, and pages without text, give an empty text; markup that is cut off, unclosed or closed
in the wrong order is read as browsers do in the main (a paragraph ends where the next begins, a closing tag without an
opening one is nothing, a tag that the page's end cuts off is nothing); html without markup is its own text; rows that
repeat are read one by one; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, and what that doesn't reach beyond.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "a": ("a", " ".join(BLOCKS))}
_ENDS |= {t: ("p", "td th table button object") for t in BLOCKS - set(_ENDS) - {"tbody", "thead", "tfoot", "optgroup", "body", "html"}}
ENDS = {t: (frozenset(a.split()), frozenset(b.split())) for t, (a, b) in _ENDS.items()}
LISTS, CELLS = frozenset("ul ol dl menu td th table".split()), frozenset("td th table".split())
TABLE, NOTHING = frozenset(["table"]), frozenset()
#: Their closing tags end whatever is open inside.
SECTIONS = frozenset("html body main article section nav aside header footer form table".split())
#: Blocks that are paragraphs of what they lie in.
PARAGRAPHS = frozenset(["p", "pre", "li", "dd", "dt", "td", "th", "blockquote", "figcaption", "summary", *HEADINGS])
#: Elements that are never part of an article.
NEVER = frozenset("head script style noscript template nav footer aside form button select textarea input iframe noembed noframes object embed svg canvas audio video map dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Words of a class or id that say the same.
SAYS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promotion promoted banner popup modal overlay lightbox
    cookie cookies consent gdpr notice notices notification notifications alert disclaimer paywall menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar
    sidebar sidebars aside widget widgets footer foot masthead comment comments commentlist disqus respond reply replies discussion feedback share sharing social related recommended
    recommendations newsletter subscribe subscription signup signin login search skip""".split()
)
SAYS_ARTICLE = frozenset(["article", "content", "entry", "post", "story"])
COMMAS = ",，、،"
#: Ancestors that points reach; how good a sibling must be beside the best, and beside what is around it; links of a list of links.
LEVELS, LIKE_BEST, LIKE_BEST_ABOVE, LINKS = 5, 0.2, 0.5, 3
#: Elements that no class or id takes out.
ALWAYS = frozenset(["html", "body", "main", "article", *HEADINGS])

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_QUALIFIED = re.compile(r"(?:^|[-_])(?:has|with|no|without|not)[-_]", re.I)
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Element:
    __slots__ = ("above", "below", "linked", "links", "out", "points", "size", "tag", "words")

    def __init__(self, tag: str, above: Element | None, words: str = "", out: bool = False):
        self.tag, self.above, self.words, self.out = tag, above, words, out
        self.below: list = []
        self.points = 0.0
        #: Characters of text, and those inside links.
        self.size = self.linked = self.links = 0


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes), ("close", tag, ""): character references are still to be decoded in text."""
    at, end, tag = 0, len(page), _TAG
    text_from = 0
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= end:
            break
        after = page[lt + 1]
        if not (after.isascii() and (after.isalpha() or after in "/!?")):
            at = lt + 1
            continue
        if after in "!?" or (after == "/" and not page[lt + 2 : lt + 3].isalpha()):
            closing = "-->" if page.startswith("<!--", lt) else ">"
            stop = page.find(closing, lt + (4 if closing == "-->" else 2))
            if page.startswith(("<!-->", "<!--->"), lt):
                stop, closing = page.find(">", lt), ">"
            if text_from < lt:
                yield "text", page[text_from:lt], ""
            at = text_from = end if stop < 0 else stop + len(closing)
            continue
        m = tag.match(page, lt)
        if m is None and tag is _TAG:  # a quote without an end: from here on, a tag ends with the next bracket
            tag = _PLAIN_TAG
            m = tag.match(page, lt)
        if text_from < lt:
            yield "text", page[text_from:lt], ""
        if m is None:  # no bracket any more: the page ends inside a tag
            return
        name = m[2].lower()
        at = text_from = m.end()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW:
            closes = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            stop = closes.start() if closes else end
            if name == "textarea":
                yield "text", page[at:stop], ""
            at = text_from = stop
    if text_from < end:
        yield "text", page[text_from:], ""


def _says(words: str) -> bool:
    for name in words.split():
        if not _QUALIFIED.search(name) and any(w.lower() in SAYS for w in _NAME.findall(name)):
            return True
    return False


def _attributes(raw: str) -> tuple[str, bool]:
    """(class and id, whether role or style take the element out)."""
    words, out = "", False
    if not raw or raw.isspace():
        return words, out
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words += " " + html.unescape(value)
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "role" and ROLES & set(value.lower().split())) or (name == "style" and _HIDDEN.search(value)):
            out = True
    return words, out


def _up(here: Element, wanted: frozenset, stops: frozenset, known: dict) -> Element | None:
    """The nearest of here and the elements around it that is wanted, or None where one of stops comes first.

    Long ways up are remembered in known, as what is around an element never changes: no page is quadratic in its depth.
    """
    x, way = here, []
    while x is not None and x.tag not in wanted and x.tag not in stops:
        if (wanted, x) in known:
            x = known[wanted, x]
            break
        way.append(x)
        x = x.above
    if x is not None and x.tag not in wanted:
        x = None
    if len(way) > 64:
        known.update(((wanted, y), x) for y in way)
    return x


def tree(page: str) -> Element:
    root = Element("", None)
    here, known = root, {}
    for kind, name, raw in tokens(page):
        if kind == "text":
            if text := html.unescape(name) if "&" in name else name:
                here.below.append(text)
        elif kind == "open":
            ends, within = ENDS.get(name, (None, None))
            if ends and (x := _up(here, ends, within, known)):
                here = x.above
            words, out = _attributes(raw)
            new = Element(name, here, words, out)
            here.below.append(new)
            if name not in VOID and not (raw.endswith("/") and name not in BLOCKS and name not in RAW):
                here = new
        elif x := _up(here, _just(name), _stops(name), known):
            here = x.above
    return root


@functools.cache
def _just(name: str) -> frozenset:
    return frozenset([name])


@functools.cache
def _stops(name: str) -> frozenset:
    """What a closing tag doesn't reach beyond."""
    if name not in BLOCKS:
        return BLOCKS
    if name in ("li", "dt", "dd"):
        return LISTS
    if name in ("tr", "td", "th", "tbody", "thead", "tfoot"):
        return TABLE
    return NOTHING if name in SECTIONS else CELLS


def _walk(top: Element) -> Iterator[tuple[Element, bool]]:
    """Elements that are not out: each with False when it opens, and with True when it closes."""
    todo = [(top, False)]
    while todo:
        x, closes = todo.pop()
        yield x, closes
        if not closes and not x.out:
            todo.append((x, True))
            todo.extend((c, False) for c in reversed(x.below) if not isinstance(c, str) and not c.out)


def _names(words: str) -> set[str]:
    return {w.lower() for name in words.split() if not _QUALIFIED.search(name) for w in _NAME.findall(name)}


def _around(root: Element) -> set[Element]:
    """Elements around an article, a main or the page's heading: no class takes them out, and no form is one only."""
    found: set[Element] = set()
    for x, closes in _walk(root):
        if not closes and (x.tag == "h1" or (x.tag in ("article", "main") and not _says(x.words))):
            above = x.above
            while above is not None and above not in found:
                if above.tag in NEVER and above.tag != "form":
                    break
                found.add(above)
                above = above.above
    return found


def _prune(root: Element) -> None:
    """Marks what is never part of an article. A header is one of the page, or the head of an article inside it."""
    around, inside = _around(root), 0
    for x, closes in _walk(root):
        counts = x.tag in ("article", "main")
        if closes:
            inside -= counts
            continue
        held = x in around or x.tag in ALWAYS
        if x.tag in NEVER:
            x.out = not (x.tag == "form" and held)
        elif x.tag == "article":
            x.out = inside > 0 and _says(x.words)
        elif not inside and x.tag != "body" and (x.tag == "header" or (x.words and "header" in _names(x.words))):
            x.out = not any(y.tag in ("article", "main") for y, c in _walk(x) if not c)
        if not (x.out or held) and x.words:
            x.out = _says(x.words)
        inside += counts and not x.out


def _length(text: str) -> int:
    return 0 if text.isspace() else len(text)


def _score(root: Element) -> None:
    """Sizes and links of all elements that are left, and their points."""
    links = 0
    for x, closes in _walk(root):
        if x.tag == "a":
            links += -1 if closes else 1
        if not closes:
            x.size = sum(_length(c) for c in x.below if isinstance(c, str))
            x.linked, x.links = x.size * bool(links), int(x.tag == "a")
        elif x.above is not None:
            x.above.size += x.size
            x.above.linked += x.linked
            x.above.links += x.links
    for x, closes in _walk(root):
        if closes or not (x.tag in BLOCKS or x is root):
            continue
        points = _own_points(x)
        # text beside blocks is a paragraph of the element that it lies in
        to, level = (x.above if x.tag in PARAGRAPHS else x), 0
        while points and to is not None and level < LEVELS:
            to.points += points / (1 if not level else 2 if level == 1 else 3 * level)
            to, level = to.above, level + 1


def _own_points(x: Element) -> float:
    """Points of x's text outside of the blocks below it."""
    size = linked = commas = 0
    todo: list = [(c, False) for c in x.below]
    while todo:
        c, link = todo.pop()
        if isinstance(c, str):
            n = _length(c)
            size += n
            linked += n * link
            commas += sum(map(c.count, COMMAS))
        elif not c.out and c.tag not in BLOCKS:
            todo.extend((d, link or c.tag == "a") for d in c.below)
    return (1 + commas + min(size / 100, 3.0)) * (1 - linked / size) * (0.5 if x.tag in HEADINGS or x.tag == "li" else 1) if size else 0.0


def _value(x: Element) -> float:
    """Points, discounted by link density; what is marked as an article counts more."""
    marked = x.tag in ("article", "main") or (x.words and SAYS_ARTICLE & _names(x.words))
    return x.points * (1.5 if marked else 1) * (1 - x.linked / x.size) if x.size else 0.0


def _chosen(root: Element) -> list[Element | str]:
    """What is kept, in page order."""
    best, most = root, _value(root)
    for x, closes in _walk(root):
        if not closes and x.tag in BLOCKS and x.tag not in PARAGRAPHS and (v := _value(x)) > most:
            best, most = x, v
    x = best
    while x is not root and x.tag not in ("article", "main"):
        x = x.above
    marked = x is not root
    top = x if marked else best
    chosen: list = [top]
    share = LIKE_BEST
    heading = any(y.tag == "h1" for y, closes in _walk(top) if not closes)
    while top.above is not None and top.tag != "body":
        beside, seen, before, after = top.above.below, False, [], []
        for c in beside:
            if c is top:
                seen = True
            elif isinstance(c, str):
                if not marked and (1 + sum(map(c.count, COMMAS)) + min(_length(c) / 100, 3.0)) * bool(_length(c)) >= share * most:
                    (after if seen else before).append(c)
            elif c.out or not c.size:
                continue
            elif marked:
                if c.tag == top.tag == "article" and _value(c) >= share * most:
                    (after if seen else before).append(c)
            elif c.tag == "h1" and not seen and not heading:
                before.append(c)
            elif max(_value(c), _own_points(c)) >= share * most and c.linked <= 0.25 * c.size:
                (after if seen else before).append(c)
        chosen = before + chosen + after
        top, share = top.above, LIKE_BEST_ABOVE
        heading = heading or any(isinstance(c, Element) and c.tag == "h1" for c in before)
    return chosen


def main_text(page: str | None) -> str:
    root = tree(page or "")
    _prune(root)
    _score(root)
    blocks, held = [], []

    def block() -> None:
        if text := " ".join("".join(held).split()):
            blocks.append(text)
        held.clear()

    chosen = _chosen(root)
    marked = any(isinstance(x, Element) and x.tag in ("article", "main") for x in chosen)
    for top in chosen:
        block()
        todo: list = [(top, False)]
        while todo:
            x, closes = todo.pop()
            if isinstance(x, str):
                held.append(x)
                continue
            few = LINKS if marked or x.tag in PARAGRAPHS else 1
            if x.out or (not closes and x is not top and x.links >= few and x.linked > 0.5 * x.size and x.tag in BLOCKS):
                continue
            if x.tag == "br" or x.tag in ("td", "th"):
                held.append(" ")
            elif x.tag in BLOCKS:
                block()
            if not closes:
                todo.append((x, True))
                todo.extend((c, False) for c in reversed(x.below))
        block()
    return "\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("html"))
    return common.map_arrow(rows, _extracted, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir):
    return extract(common.read_table(spark, sf_dir, "pages"))
