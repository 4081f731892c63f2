"""Queries over marked-up texts, stored pages and stored answers, all made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import markup
from folioscan.operators import fetch, rank, requests, search, spread
from folioscan.plans.queries import _EVERY_THIRD, PATTERN, _docs, _hits, _t, query
from folioscan.sources import hits

# --- marked-up texts ---------------------------------------------------------------------------------------------


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _marked(c: str) -> str:
    return f"replace({_escaped(c)}, chr(10), '<lb n=\"1\"/>')"


def _plain(c: str) -> str:
    """SQL: lines with their white space collapsed, at most one blank on end, none around."""
    each = f"list_transform(string_split(replace({c}, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
    return f"trim(regexp_replace(array_to_string({each}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


_TEI = f"concat('<TEI><teiHeader><title>header</title></teiHeader><text><body><p>', {_marked('text')}, '<note>unseen <hi>note</hi></note></p></body></text></TEI>')"


@query("tei_plain", f"SELECT doc_id, {_plain('text')} AS text FROM documents")
def tei_plain(spark, sf_dir):
    plain = spread.by_text(markup.plain_text, "string")
    return _docs(spark, sf_dir).select("doc_id", plain(F.expr(_TEI)).alias("text"))


_HALVES = ["substr(text, 1, cast(floor(length(text) / 2) AS int))", "substr(text, cast(floor(length(text) / 2) AS int) + 1)"]
_JUAN = f"""concat('<TEI><teiHeader>h</teiHeader><text>', '<juan n="001" fun="open"/>', {_marked(_HALVES[0])}, '<juan n="001" fun="close"/>', 'between', '<juan n="002" fun="open"/>', {_marked(_HALVES[1])}, '<juan n="002" fun="close"/>', 'after</text></TEI>')"""


@query("juan_extract", f"SELECT doc_id, nullif({_plain(_HALVES[1])}, '') AS text FROM documents")
def juan_extract(spark, sf_dir):
    """The second of two parts, asked for by a number without zeros."""
    part = spread.by_text(lambda x: markup.part_text(x, "2"), "string")
    return _docs(spark, sf_dir).select("doc_id", part(F.expr(_JUAN)).alias("text"))


_CHARS = """<charDecl><char xml:id="G1"><charName>one</charName><mapping type="normal">n1</mapping><mapping type="unicode">U1</mapping></char><char xml:id="G2"><charName>two</charName><mapping type="normal">N2</mapping></char><char xml:id="G3"><charName>C3</charName></char></charDecl>"""
_GAIJI = f"""concat('<TEI><teiHeader>{_CHARS}</teiHeader><text><p>', replace(replace(replace({_marked("translate(text, 'eta', concat(chr(1), chr(2), chr(3)))")}, chr(1), '<g ref="#G1"/>'), chr(2), '<g ref="#G2">x</g>'), chr(3), '<g ref="#G3"/>'), '</p></text></TEI>')"""


@query("gaiji_resolve", f"SELECT doc_id, {_plain('''replace(replace(replace(text, 'e', 'U1'), 't', 'N2x'), 'a', 'C3')''')} AS text FROM documents")
def gaiji_resolve(spark, sf_dir):
    """Three letters of the documents written as declared characters: by code, by their normal form, by name."""
    plain = spread.by_text(markup.plain_text, "string")
    return _docs(spark, sf_dir).select("doc_id", plain(F.expr(_GAIJI)).alias("text"))


@query("line_context_text", r"""WITH d AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\r?\n$', ''), chr(10)) END AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) >= 3 THEN trim(regexp_replace(array_to_string(ls[2:least(5, len(ls))], ' '), '\s+', ' ', 'g')) ELSE '' END AS passage FROM d""")
def line_context_text(spark, sf_dir):
    xml = F.expr(_escaped("text"))
    return _docs(spark, sf_dir).select("doc_id", fetch.context_text(xml, F.lit(3), 1, 2).alias("passage"))


_MARKED = "replace(text, ' the ', ' <lb n=\"7a\"/>the ')"
_WITH_MARKS = f"WITH md AS (SELECT * REPLACE ({_MARKED} AS text) FROM documents), {_hits(PATTERN).replace('FROM documents', 'FROM md')}"


@query("match_markers", f"{_WITH_MARKS} SELECT doc_id, line_number, CASE WHEN contains(context, '<lb ') THEN '7a' END AS lb FROM capped")
def match_markers(spark, sf_dir):
    found = search.grep(_docs(spark, sf_dir).withColumn("text", F.expr(_MARKED)), PATTERN, 5)
    return search.with_markers(found).select("doc_id", F.inline("matches")).select("doc_id", "line_number", "lb")


@query("marker_suggestions", f"{_WITH_MARKS} SELECT doc_id, CASE WHEN contains(context, '<lb ') THEN '7a' END AS lb, CASE WHEN NOT contains(context, '<lb ') THEN line_number END AS line_number FROM counted JOIN (SELECT doc_id, line_number, any_value(context) AS context FROM hits GROUP BY ALL) USING (doc_id, line_number) ORDER BY total_matches DESC, doc_id LIMIT 5")
def marker_suggestions(spark, sf_dir):
    found = search.grep(_docs(spark, sf_dir).withColumn("text", F.expr(_MARKED)), PATTERN, 5)
    return search.marked_suggestions(found, "doc_id", 5)


_DIVIDED = f"concat('<TEI><div n=\"', doc_id, '\" type=\"vagga\"/><p>tiny</p><p> Collection ', source, ' </p><div n=\"2\"/><div n=\"3\" type=\"sutta\"><p>', {_escaped('text')}, '</p></div></TEI>')"
_TITLED = f"WITH md AS (SELECT * REPLACE ({_DIVIDED} AS text) FROM documents), {_hits(PATTERN).replace('FROM documents', 'FROM md')}"


@query("grep_structured", f"{_TITLED}, t AS (SELECT * FROM counted ORDER BY doc_id LIMIT 20) SELECT doc_id, total_matches, 'Collection ' || source || ' · tiny' AS title, [doc_id || '(vagga)', '3(sutta)'] AS structure_info, doc_id || '(vagga)' AS section FROM t")
def grep_structured(spark, sf_dir):
    """Files in the order of their paths, with titles and divisions: read of those that are shown only."""
    files = _docs(spark, sf_dir, "source").withColumn("text", F.expr(_DIVIDED))
    found = search.structured(search.path_order(search.grep(files, PATTERN, 5), "doc_id", 20), "doc_id")
    return found.select("doc_id", "total_matches", "title", "structure_info", F.col("matches")[0]["section"].alias("section"))


# --- fetching by requests ----------------------------------------------------------------------------------------


def _file(lines: tuple[str, str]) -> tuple[str, str]:
    """A file of two parts: the lines with markers, and the lines again; in SQL of DuckDB and of Spark."""
    shape = "concat('<TEI><juan n=\"001\" fun=\"open\"/><head>Part one</head>', chr(10), {0}, chr(10), '<juan n=\"001\" fun=\"close\"/><juan n=\"002\" fun=\"open\"/><head>Part <hi>two</hi></head>', chr(10), {1}, chr(10), '<juan n=\"002\" fun=\"close\"/></TEI>')"
    return tuple(shape.format(*x) for x in zip(lines, (_AGAIN[0], _AGAIN[1]), strict=True))


_E = _escaped("text")
_AGAIN = f"array_to_string(list_transform(string_split({_E}, chr(10)), lambda x: concat('again ', x)), chr(10))", f"array_join(transform(split({_E}, chr(10)), x -> concat('again ', x)), chr(10))"
_BY_LINE = f"array_to_string(list_transform(string_split({_E}, chr(10)), lambda x, i: concat('<lb n=\"', i, '\"/>', x)), chr(10))", f"array_join(transform(split({_E}, chr(10)), (x, i) -> concat('<lb n=\"', i + 1, '\"/>', x)), chr(10))"
_FILES = _file(_BY_LINE)
#: SQL: the texts of the file's lines, and what extraction makes of some of them.
_W = "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, list_transform(string_split(text, chr(10)), lambda x: concat('again ', x)) AS a FROM documents), w AS (SELECT doc_id, len(l) AS n, list_concat(['Part one'], l, ['Part two'], a, ['']) AS w FROM d)"


def _flat(xs: str) -> str:
    return f"trim(regexp_replace(array_to_string({xs}, ' '), '\\s+', ' ', 'g'))"


def _files(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.expr(_FILES[1]).alias("text"))


@query("fetch_by_marker", f"""{_W}, x AS (SELECT doc_id, 1 + doc_id % 7 AS k, n, w FROM w), b AS (SELECT doc_id, k <= n AS hit, CASE WHEN k <= n THEN {_flat('w[k + 1:k + 2]')} ELSE {_flat('w')} END AS body FROM x)
SELECT doc_id, CASE WHEN hit THEN 'lb-context' ELSE 'full' END AS method, left(left(body, 8000), 6000) AS passage, length(body)::INT AS total FROM b""")
def fetch_by_marker(spark, sf_dir):
    """Of each file the lines from a marker on; files without it are given whole."""
    asked = _docs(spark, sf_dir).selectExpr("doc_id AS request_id", "doc_id AS id", "cast(1 + doc_id % 7 AS string) AS lb", "0 AS before", "1 AS after")
    found = requests.fetch_requests(asked, _files(spark, sf_dir), file_id="doc_id")
    return found.select(F.col("request_id").alias("doc_id"), "method", "passage", "total")


@query("fetch_by_part", f"SELECT doc_id, 'part' AS method, {_plain('''concat('Part two', chr(10), array_to_string(list_transform(string_split(text, chr(10)), lambda x: concat('again ', x)), chr(10)))''')} AS passage FROM documents")
def fetch_by_part(spark, sf_dir):
    """The second part of each file, whole and with its line breaks."""
    asked = _docs(spark, sf_dir).selectExpr("doc_id AS request_id", "doc_id AS id", "'2' AS part", "true AS plain", "true AS full")

    return requests.fetch_requests(asked, _files(spark, sf_dir), file_id="doc_id", most=None).select(F.col("request_id").alias("doc_id"), "method", "passage")


@query("fetch_requests", f"""{_W}, x AS (SELECT *, doc_id % 7 AS kind, 1 + doc_id % 5 AS k FROM w),
b AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN k <= n THEN {_flat('w[k:k + 2]')} ELSE {_flat('w')} END WHEN 1 THEN {_flat('w[2:4]')} WHEN 2 THEN {_flat('w[n + 2:]')} WHEN 3 THEN {_flat('w[n + 3:]')} WHEN 4 THEN {_flat('w[2:n + 1]')} ELSE {_flat('w')} END AS body FROM x),
c AS (SELECT *, length(body) AS total, CASE kind WHEN 5 THEN least(50, length(body)) WHEN 6 THEN least(3, length(body)) ELSE 0 END AS lo, CASE kind WHEN 5 THEN least(100, length(body)) WHEN 6 THEN least(903, length(body)) WHEN 4 THEN length(body) ELSE least(8000, length(body)) END AS hi FROM b),
s AS (SELECT *, substr(body, lo + 1, hi - lo) AS slice FROM c)
SELECT doc_id AS request_id, CASE WHEN kind = 0 THEN CASE WHEN k <= n THEN 'lb-context' ELSE 'full' END WHEN kind = 1 THEN 'line-context' WHEN kind = 2 THEN 'part' WHEN kind = 3 THEN 'head-query' WHEN kind = 4 THEN 'head-index' WHEN kind = 5 AND regexp_matches(body, 'tion|gain') THEN 'highlight-context' ELSE 'full' END AS method,
  left(CASE WHEN kind >= 5 THEN regexp_replace(slice, '(tion|gain)', '[\\1]', 'g') ELSE slice END, 6000) AS passage, total::INT AS total, lo::INT AS "start", hi::INT AS "end", CASE WHEN kind >= 5 THEN len(regexp_extract_all(slice, 'tion|gain')) ELSE 0 END::INT AS highlighted FROM s""")
def fetch_requests(spark, sf_dir):
    """A request for each file, of seven kinds, some with slices and marks."""
    k = "doc_id % 7"
    asked = _docs(spark, sf_dir).selectExpr(
        "doc_id AS request_id", "array(-1 - doc_id, doc_id) AS ids", f"CASE WHEN {k} = 0 THEN cast(1 + doc_id % 5 AS string) END AS lb", f"CASE WHEN {k} = 1 THEN 3 END AS line_number", f"CASE WHEN {k} IN (1, 2) THEN '2' END AS part",
        f"CASE WHEN {k} = 3 THEN 'pART <HI>' END AS head_query", f"CASE WHEN {k} = 4 THEN 0 END AS head_index", f"CASE WHEN {k} < 2 THEN 1 END AS before", f"CASE WHEN {k} < 2 THEN 1 END AS after", f"CASE WHEN {k} = 5 THEN 1 END AS page",
        f"CASE WHEN {k} = 5 THEN 50 END AS page_size", f"CASE WHEN {k} = 6 THEN 3 END AS start_char", f"CASE WHEN {k} = 6 THEN 900 END AS max_chars", f"{k} = 4 AS full", f"CASE WHEN {k} >= 5 THEN 'tion|gain' END AS highlight", "'[' AS prefix", "']' AS suffix",
    )
    found = requests.fetch_requests(asked, _files(spark, sf_dir), file_id="doc_id")
    return found.select("request_id", "method", "passage", "total", "start", "end", "highlighted")


# --- stored answers ----------------------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    """Search answers as stored, a page of 20 documents each."""
    p = _t(spark, sf_dir, "part").withColumn("page", F.expr("p_partkey div 20"))
    doc = "struct(p_partkey AS k, struct(cast(p_partkey AS string) AS id, p_name AS fascnm, concat(p_partkey, ',a,', p_size) AS startid, concat('about the ', p_name) AS body) AS d)"
    docs = F.transform(F.array_sort(F.collect_list(F.expr(doc))), lambda x: x["d"])
    return p.groupBy("page").agg(F.to_json(F.struct(F.struct((F.count("*") + 7).alias("numFound"), docs.alias("docs")).alias("response"))).alias("answer"))


def _searched(spark, sf_dir):
    """The documents of all pages, with their place in all."""
    docs = hits.searched(_answers(spark, sf_dir), "answer", "page")
    return docs.withColumn("pos", (F.col("page") * 20 + F.col("pos")).cast("int"))


@query("sat_search", "SELECT p_partkey // 20 AS page, (row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1)::INT AS pos, p_partkey::VARCHAR AS id, p_name AS title, 'T' || p_partkey AS t_number, '11..' || least(20, count(*) OVER (PARTITION BY p_partkey // 20) + 7) AS shown, 'T' || p_partkey || ' ' || p_name || ' [useid: ' || p_partkey || ']' AS line FROM part")
def sat_search(spark, sf_dir):
    docs = hits.searched(_answers(spark, sf_dir), "answer", "page")
    return docs.select("page", "pos", "id", F.col("fascnm").alias("title"), "t_number", hits.paging(F.col("count"), 10, 10).alias("shown"), hits.display_line(F.col("startid"), F.col("fascnm"), F.col("id")).alias("line"))


@query("sat_titles", "WITH d AS (SELECT p_name AS title, p_partkey AS pos FROM part) SELECT title, min(pos)::INT AS pos FROM d WHERE pos < 500 AND contains(replace(lower(title), ' ', ''), 'ring') GROUP BY title ORDER BY 2 LIMIT 100 OFFSET 1")
def sat_titles(spark, sf_dir):
    return hits.searched_titles(_searched(spark, sf_dir), "Ring", 100, 1)


_BASE = "https://texts.example.org/detail"
_LONG = "concat('Page of ', p_brand, ' ', repeat('filler ', 12), 'the green  widget here')"


def _stored(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("url", hits.detail_url(F.expr("concat(p_partkey, ',a,', p_size)"), _BASE))
    return p.select(hits.cache_key(F.col("url")).alias("key"), F.expr(f"concat('<html><body><span class=\"tx\">', {_LONG}, '</span><span class=\"tx\"> second </span></body></html>')").alias("html"))


_CHOSEN = "b AS (SELECT *, " + _LONG + " || chr(10) || 'second' AS body FROM part"


@query("sat_pipeline", f"""WITH {_CHOSEN} WHERE contains(replace(lower(p_name), ' ', ''), 'widget') ORDER BY p_partkey LIMIT 1)
SELECT p_partkey::VARCHAR AS id, 0 AS tier, substr(body, greatest(strpos(body, 'widget') - 50, 1), 60) AS passage, length(body)::INT AS total, greatest(strpos(body, 'widget') - 51, 0)::INT AS "start" FROM b""")
def sat_pipeline(spark, sf_dir):
    docs = _searched(spark, sf_dir)
    return fetch.online_pipeline(docs, _stored(spark, sf_dir), '"Widget"', _BASE, most=60).select("id", "tier", "passage", "total", "start")


@query("sat_autofetch", f"""WITH {_CHOSEN} WHERE p_name = 'red widget' ORDER BY p_partkey LIMIT 1) SELECT p_partkey::VARCHAR AS id, substr(body, 6, 20) AS passage, 5 AS "start", 25 AS "end" FROM b""")
def sat_autofetch(spark, sf_dir):
    docs = _searched(spark, sf_dir)
    best = rank.pick_by_title(docs, "red widget", "fascnm", "pos").withColumn("url", hits.detail_url(F.col("startid"), _BASE))
    return fetch.fetch_stored(best, _stored(spark, sf_dir), start=5, most=20).select("id", "passage", "start", "end")


_DESCRIBED = 'concat(\'bdr:I1 rdfs:seeAlso "https://x.example/none" ; rdfs:seeAlso "https://github.com/Openpecha-Data/R\', c_custkey % 20, \'.git#x" .\')'


@query("tibetan_fetch", """WITH w AS (SELECT c_custkey AS c, CASE c_custkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'IE' ELSE 'W' END || c_custkey AS id FROM customer),
t AS (SELECT *, CASE WHEN c % 8 = 0 THEN 'chunk ' || c || chr(10) || 'two' END AS chunk, CASE WHEN c % 2 = 0 AND c % 12 <> 6 THEN 'bo ' || c || chr(10) || 'plain' END AS snippet, CASE WHEN c % 3 = 0 AND c % 9 = 0 THEN 'own ' || c END AS own,
  CASE WHEN c % 5 = 1 AND (c % 20) % 2 = 0 THEN 'repository ' || (c % 20) END AS referred FROM w)
SELECT id, coalesce(chunk, snippet, own, referred) AS text, CASE WHEN chunk IS NOT NULL THEN 'chunks' WHEN snippet IS NOT NULL THEN 'snippet' WHEN own IS NOT NULL OR referred IS NOT NULL THEN 'base' END AS method FROM t""")
def tibetan_fetch(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS c", "concat(CASE c_custkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'IE' ELSE 'W' END, c_custkey) AS id", f"{_DESCRIBED} AS turtle")
    pairs = """concat('{"ut":"', CASE WHEN c % 4 = 0 THEN concat('UT', c) ELSE '' END, '","snippet":', CASE WHEN c % 12 = 6 THEN '[]' ELSE concat('[["bo ', c, '","bo"],["other","en"],"plain"]') END, '}') AS answer"""
    chunks = """concat('[{"innerHits":{"chunks":{"hits":[{"sourceAsMap":{"text_bo":"chunk ', c, '"}},{"x":1},{"sourceAsMap":{"text_bo":"two"}}]}}},{}]') AS answer"""
    texts = c.filter("c % 9 = 0").selectExpr("concat('I', c) AS repository", "concat('own ', c) AS text").union(spark.range(0, 20, 2).selectExpr("concat('R', id)", "concat('repository ', id)"))
    return hits.archive_fetch(c.select("id"), c.filter("c % 2 = 0").selectExpr("id", pairs), c.filter("c % 8 = 0").selectExpr("concat('UT', c) AS ut", chunks), texts, c.filter("c % 5 = 1").select("id", "turtle"))


_HIT = """concat('{"hits":{"hits":[{"_score":', p_size, '.5,"fields":{"kdb":["k', p_partkey, '"],"sutra":"s","pb":"p1","tname":["', p_name, '"]},"highlight":{"text":["<mark>a</mark>b","c"]}},{"fields":{"cname":"', p_name, '"},"highlight":{"textWildcard":"w<mark>x</mark>"}}]}}')"""


_READER = "https://reader.example.org/index.html"


@query("page_hits", """SELECT p_partkey AS part, pos, CASE pos WHEN 0 THEN p_size + 0.5 ELSE 0 END::DOUBLE AS score, p_name AS title, CASE pos WHEN 0 THEN 'k' || p_partkey ELSE '' END AS kdb, CASE pos WHEN 0 THEN 'abc' ELSE 'wx' END AS snippet,
CASE pos WHEN 0 THEN 'https://reader.example.org/index.html?kdb=k' || p_partkey || '&sutra=s&page=p1&highlight=' ELSE 'https://reader.example.org/index.html?kdb=&sutra=&page=&highlight=' END || replace(p_name, ' ', '%20') AS link FROM part, (VALUES (0), (1)) v(pos)""")
def page_hits(spark, sf_dir):
    answers = spread.evenly(_t(spark, sf_dir, "part")).select("p_partkey", F.expr(_HIT).alias("answer"))
    h = hits.page_hits(answers, "answer", 0, "p_partkey")
    link = hits.reader_link(_READER, *[F.col(c) for c in ("kdb", "sutra", "pb", "kind", "title")])
    return h.select(F.col("p_partkey").alias("part"), "pos", "score", "title", "kdb", "snippet", link.alias("link"))


@query("title_list", "WITH t AS (SELECT n_nationkey::VARCHAR AS id, n_name AS title, n_nationkey % 5 AS score FROM nation ORDER BY score DESC, id LIMIT 10), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM t) SELECT string_agg(r || '. ' || id || '  ' || title, chr(10) ORDER BY r) AS text FROM n")
def title_list(spark, sf_dir):
    t = _t(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS string) AS id", "n_name AS title", "n_name AS path", "cast(n_nationkey % 5 AS double) AS score")
    return rank.printed(rank.top_k(t, 10, "id"))
