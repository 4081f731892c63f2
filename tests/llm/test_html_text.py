import html
import re
import time

import pytest

from folioscan.llm import html_text
from folioscan.llm.html_text import main_text

FIRST = "The first paragraph is long enough, has commas, and says what the page is about in a plain way."
SECOND = "The second one goes on, with more words, so that nobody takes it for a caption or a notice."
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
BODY = f"<h1>Title</h1><p>{FIRST}</p><p>{SECOND}</p>"
TEXT = f"Title\n{FIRST}\n{SECOND}"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body>{MENU}<article>{BODY}</article><footer>&copy; me, and others, too</footer></body></html>",
        f"<body>{MENU}<div class='ad'>Buy this, now, or never, as they say, it is cheap.</div><div id=content>{BODY}</div><div class='sidebar'><p>Also, read, this, and, that, and, more.</p></div></body>",
        f"<body><header><a href=/>Site</a> slogan, of the, site</header><main><header>{BODY[:14]}</header>{BODY[14:]}</main><div class=comments><p>I, too, think so, and {SECOND}</p></div></body>",
        f"<body><div class='page has-sidebar'><div><div>{BODY}</div></div><aside>{SECOND}</aside></div></body>",
        f"<body><form action=x><article>{BODY}<form><input value=1><label>Your name, please</label></form></article></form></body>",
        f"<article>{BODY}<div class='related'><a href=1>One</a></div><ul><li><a>a link</a><li><a>another</a><li><a>third</a></ul></article>",
        f"<article>{BODY}<section class='post-comments'><article class='comment'><p>{SECOND}</p></article></section></article>",
        f"<div role=navigation>{SECOND}</div><div>{BODY}</div><div style='display: none'>{SECOND}</div><p hidden>{SECOND}",
        f"<div class=cookie-notice><p>{SECOND}</p></div><div class=entry>{BODY}<script>var a='<p>{FIRST}</p>'</script><noscript><p>Turn it on</p></noscript></div>",
        f"<article><h1>Title<p>{FIRST}<p>{SECOND}<foot",
        f"<body><h1>Title</h1><div class=meta></div><div><p>{FIRST}<p>{SECOND}</div></body>",
    ],
)
def test_article_without_what_is_around_it(page):
    assert main_text(page) == TEXT


def test_blocks_and_white_space():
    assert main_text("<article><p>a  b<br>c\n\td&nbsp;e</p><div>f<p>g</p>h</div><ul><li>i<li>j</ul><table><tr><td>k<td>l<tr><td>m</table></article>") == "a b c d e\nf\ng\nh\ni\nj\nk l\nm"
    assert main_text("<p>x &lt;b&gt; &amp;amp; &#8364;&#x20AC;&copy &am</p>") == "x <b> &amp; €€© &am"
    assert main_text("<p>1 < 2 and 3 > 2, <3</p>") == "1 < 2 and 3 > 2, <3"
    assert main_text('<p title="a > b">one <!-- <p>no</p> -->two<![CDATA[x]]><?y?></p>') == "one two"
    assert main_text("<p><b>bold<br><p>next</b> one</p>") == "bold\nnext one"
    assert main_text("plain text only") == "plain text only"
    assert main_text("<SCRIPT>x</SCRIPT ><P>y</P>") == "y"
    assert main_text("<p>a<textarea>no</textarea></p><p>b <a href='x>y'>link</a></p>") == "a\nb link"


def test_nothing_to_extract():
    assert {main_text(x) for x in (None, "", " ", "<html></html>", "<nav>menu</nav>", "<p", "</p>", "<!--", "<script>x")} == {""}


def test_sections_beside_the_best_are_kept():
    parts = [f"{FIRST} Part {i}." for i in range(6)]
    page = "<body>" + MENU + "".join(f"<div class=section><h2>Head {i}</h2><p>{p}</p><p>{SECOND}</p></div>" for i, p in enumerate(parts)) + f"<div><a href=1>{FIRST}</a></div></body>"
    assert main_text(page) == "\n".join(f"Head {i}\n{p}\n{SECOND}" for i, p in enumerate(parts))


def test_a_short_article_beside_a_long_advert():
    assert main_text(f"<nav>{MENU}</nav><div class=ad>{FIRST * 9}</div><article><h1>Hi</h1><p>Yes.</p></article><footer>{SECOND * 9}</footer>") == "Hi\nYes."


@pytest.mark.parametrize("bad", ["<a ", "<div>", "<b>", "<p>x", "<div><p>", "<table><td>", "</div>", "<a href='", '<a x="y>', "<!-", "<", "&", "<ul><li>", "<p><table><td><div>", "<span></b>"])
def test_long_and_deep_pages_take_linear_time(bad):
    began = time.time()
    got = main_text(f"<article>{BODY}{bad * 60_000}</article>")
    assert got.startswith(TEXT)
    assert time.time() - began < 10


def test_given_pages(spark):
    """The given pages have one form, which a regular expression reads too."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(filter(None, blocks))


def test_odd_rows(spark):
    rows = [(1, "u", "<p>same", "t"), (1, "u", "<p>same", "t"), (None, None, None, None), (2, None, "", "t"), (3, "v", f"<p>{'long ' * 200_000}", "t")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(got, key=str) == sorted([(1, "u", "same", 4)] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", " ".join(["long"] * 200_000), 999_999)], key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
