"""Queries over normal forms, catalogues, files and stored pages, all made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import markup, tibetan
from folioscan.functions import text as T
from folioscan.operators import fetch, rank, search, spread
from folioscan.plans.passages import _plain
from folioscan.plans.queries import _AROUND, _CANDIDATE, _NORM, PATTERN, _digit, _docs, _t, query
from folioscan.sources import catalog, hits, readers


def _part(spark, sf_dir, **columns: str):
    return _t(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{sql} AS {name}" for name, sql in columns.items()])


# --- normal forms ------------------------------------------------------------------------------------------------


@query("fold_ascii", r"SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}\s]', '', 'g') AS folded FROM documents")
def fold_ascii(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fold_ascii(F.col("text")).alias("folded"))


_MESSY = "replace(replace(text, ' the ', concat('  ', chr(9), ' the', chr(13), ' ')), chr(10), concat(' ', chr(10), chr(10), chr(10), chr(9)))"
_TRIMMED = f"list_transform(string_split(replace({_MESSY}, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"


@query("plain_lines", f"SELECT doc_id, {_plain(_MESSY)} AS plain, regexp_replace(array_to_string({_TRIMMED}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS trimmed FROM documents")
def plain_lines(spark, sf_dir):
    text = F.expr(_MESSY)
    return _docs(spark, sf_dir).select("doc_id", T.plain_lines(text).alias("plain"), T.trimmed_lines(text).alias("trimmed"))


_NUMBERED = "concat(p_name, ' ', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END, ' x', p_size, '.', p_partkey)"


@query("first_numbers", f"SELECT p_partkey, regexp_extract({_NUMBERED}, '[0-9]+') AS one, regexp_extract_all({_NUMBERED}, '[0-9]+')[1:2] AS two, nullif(regexp_extract(p_name, '[0-9]+'), '') AS none FROM part")
def first_numbers(spark, sf_dir):
    n = F.expr(_NUMBERED)
    return _t(spark, sf_dir, "part").select("p_partkey", T.first_number(n).alias("one"), T.numbers(n).alias("two"), T.first_number(F.col("p_name")).alias("none"))


_PALI = "CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE concat(' ', translate(p_name, 'aiu', 'āīū'), ' sutta', p_size, ' ') END"


@query("title_variants", rf"""WITH t AS (SELECT p_partkey, trim({_PALI}) AS b FROM part), l AS (SELECT *, replace(b, 'sutta', 'suttanta') AS n FROM t)
SELECT p_partkey, CASE WHEN b = '' THEN [] ELSE [b, lower(strip_accents(b)), replace(replace(replace(lower(b), 'ā', 'aa'), 'ī', 'ii'), 'ū', 'uu'), n, lower(strip_accents(n))] END AS variants FROM l""")
def title_variants(spark, sf_dir):
    return _part(spark, sf_dir, t=_PALI).select("p_partkey", T.title_variants(F.col("t")).alias("variants"))


@query("collection_titles", f"SELECT p_partkey, regexp_matches({_NORM.format(_CANDIDATE)}, 'tripitaka|taisho|canon') AS collection FROM part")
def collection_titles(spark, sf_dir):
    return _part(spark, sf_dir, t=_CANDIDATE).select("p_partkey", T.is_collection_title(F.col("t")).alias("collection"))


_SHAPED = "CASE c_custkey % 6 WHEN 0 THEN concat(' J', lpad(cast(c_custkey % 20000 AS varchar(9)), 4, '0'), ' ') WHEN 1 THEN concat('bla ma ', c_custkey) WHEN 2 THEN concat('བླ', c_custkey) WHEN 3 THEN concat('a', c_custkey) WHEN 4 THEN '   ' ELSE c_name END"


@query("query_shapes", rf"""WITH s AS (SELECT c_custkey, trim({_SHAPED}) AS s FROM customer) SELECT c_custkey, regexp_full_match(s, '[\x00-\x7F]*') AND len(regexp_extract_all(s, '[A-Za-z]')) >= 2 AS ewts, regexp_full_match(s, '[A-Za-z][0-9]{{4}}') AS text_number FROM s""")
def query_shapes(spark, sf_dir):
    s = F.expr(_SHAPED)
    return _t(spark, sf_dir, "customer").select("c_custkey", T.looks_like_ewts(s).alias("ewts"), T.is_text_number(s).alias("text_number"))


@query("haystacks", """SELECT p_partkey, p_name || ' ' || p_partkey || ' ' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand || ' ' || p_size || ' ' || p_type END AS hay, p_name || ' ' || p_partkey || ' ' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type || ' ' || p_brand END AS pali FROM part""")
def haystacks(spark, sf_dir):
    """All metadata in the order of their keys, and those that count for titles in Pali."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t"), F.col("p_partkey").cast("string").alias("i"), F.expr("CASE WHEN p_partkey % 4 <> 0 THEN map('date', cast(p_size AS string), 'alias', p_type, 'author', p_brand, 'nikaya', p_brand) END").alias("meta"))
    p = p.withColumn("plain", F.map_filter("meta", lambda k, v: k != "alias")).withColumn("plain", F.map_concat(F.map_filter("plain", lambda k, v: k != "nikaya"), F.create_map(F.lit("z"), F.col("meta")["alias"])))
    hay = lambda m, *k: rank.haystack(F.col("t"), F.col("i"), m, *k)
    return p.select("p_partkey", hay(F.col("plain")).alias("hay"), hay(F.col("meta"), rank.PALI_KEYS).alias("pali"))


# --- files and catalogues ----------------------------------------------------------------------------------------

_SOME_PATH = "concat('/corpus/', CASE p_partkey % 7 WHEN 0 THEN '.git/' WHEN 1 THEN 'out/' WHEN 2 THEN 'a/tools/' WHEN 3 THEN '__MACOSX/' WHEN 4 THEN 'T/' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 'toc' WHEN 1 THEN 'a.Sitemap' WHEN 2 THEN 'tree' ELSE 'f' END, p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.XML' ELSE '.xml' END)"


@query("corpus_files", rf"""WITH f AS (SELECT {_SOME_PATH} AS path FROM part), n AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS name, path LIKE '%.xml' AS xml FROM f)
SELECT 'sarit' AS corpus, path FROM n WHERE xml AND NOT regexp_matches(path, '/([.]git|out|schemas|tools)/') UNION ALL SELECT 'muktabodha', path FROM n WHERE (xml OR path LIKE '%.txt') AND NOT regexp_matches(path, '/([.]git|__MACOSX)/')
UNION ALL SELECT 'tipitaka', path FROM n WHERE xml AND NOT regexp_matches(name, 'toc|sitemap') UNION ALL SELECT 'tipitaka_index', path FROM n WHERE xml AND NOT regexp_matches(name, 'toc|sitemap|tree') UNION ALL SELECT 'plain', path FROM n WHERE xml AND contains(path, '/T/')""")
def corpus_files(spark, sf_dir):
    """Which of all files each kind of corpus takes; of the plain one those of a folder."""
    f = _t(spark, sf_dir, "part").selectExpr(f"{_SOME_PATH} AS path")
    per = [readers.of_corpus(f, c, "/T/" if c == "plain" else None).select(F.lit(c).alias("corpus"), "path") for c in ("sarit", "muktabodha", "tipitaka", "tipitaka_index", "plain")]
    out = per[0]
    for p in per[1:]:
        out = out.unionByName(p)
    return out


@query("decode_strict", r"SELECT doc_id, text AS utf8, text AS utf16, CASE WHEN regexp_full_match(text, '(?s)[\x00-\x7F]*') THEN text END AS latin FROM documents WHERE NOT regexp_matches(text, '[^\x{0}-\x{FF}]')")
def decode_strict(spark, sf_dir):
    """By byte order mark, else UTF-8: bytes that are neither give nothing."""
    d = _docs(spark, sf_dir).filter(~F.col("text").rlike(r"[^\x{0}-\x{FF}]"))
    return d.select("doc_id", readers.decode_strict(F.encode("text", "UTF-8")).alias("utf8"), readers.decode_strict(F.encode("text", "UTF-16")).alias("utf16"), readers.decode_strict(F.encode("text", "ISO-8859-1")).alias("latin"))


_TEI = """concat('<TEI xml:id="x', p_partkey, '"><teiHeader><fileDesc><titleStmt>', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('<title level="s" xml:lang="en">Series ', p_brand, '</title><title level="m" type="main" xml:lang="zh">', p_name, '</title>') END,
 '<author>A', p_size, '</author><editor>E</editor><respStmt><resp>', CASE p_partkey % 3 WHEN 0 THEN 'Translated by' ELSE 'Edited by' END, '</resp><name>N', p_size % 7, '</name></respStmt></titleStmt><publicationStmt><publisher>P</publisher><date>', 1900 + p_size, '</date><idno>I', p_partkey, '</idno></publicationStmt></fileDesc>',
 '<profileDesc><keywords><term>k1</term><term>', p_size, '</term></keywords></profileDesc></teiHeader><text><head>H1 ', p_type, '</head><juan fun="open" n="1"/><juan fun="close"/><juan fun="open" n="2"/><head>H2</head></text></TEI>')"""
_NAME = "concat(CASE WHEN p_partkey % 2 = 0 THEN 'T/T08/T08n' ELSE 'X/x' END, p_partkey, '.xml')"
_STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')"


def _built(spark, sf_dir, corpus: str, *meta: str, xml: str = _TEI, name: str = _NAME):
    built = catalog.build(spread.evenly(_t(spark, sf_dir, "part")).selectExpr(f"{name} AS path", f"{xml} AS text"), corpus)
    return built.select("id", "title", "path", *[F.col("meta")[k].alias(k) for k in meta])


_ROWS = f"WITH f AS (SELECT *, {_NAME} AS path FROM part), s AS (SELECT *, {_STEM} AS stem FROM f)"


@query("index_sarit", f"{_ROWS} SELECT stem AS id, CASE WHEN p_partkey % 4 = 0 THEN stem ELSE p_name END AS title, path, 'x' || p_partkey AS \"xmlId\", 'A' || p_size AS author, 'E' AS editor, 'sarit_index_v1' AS \"indexVersion\" FROM s")
def index_sarit(spark, sf_dir):
    return _built(spark, sf_dir, "sarit", "xmlId", "author", "editor", "indexVersion")


@query("index_muktabodha", f"{_ROWS} SELECT stem AS id, CASE WHEN p_partkey % 4 = 0 THEN stem ELSE 'Series ' || p_brand END AS title, path, 'xml' AS ext, 'muktabodha_index_v1' AS \"indexVersion\" FROM s")
def index_muktabodha(spark, sf_dir):
    return _built(spark, sf_dir, "muktabodha", "ext", "indexVersion")


_HEADS = "'H1 ' || p_type || ' | H2'"


@query("index_gretil", f"""{_ROWS} SELECT stem AS id, CASE WHEN p_partkey % 4 = 0 THEN stem ELSE p_name END AS title, path, 'A' || p_size AS author, CASE WHEN p_partkey % 3 = 0 THEN 'N' || p_size % 7 END AS translator, 'P' AS publisher, (1900 + p_size)::VARCHAR AS date, 'I' || p_partkey AS idno,
{_HEADS} AS "headsPreview", CASE p_partkey % 3 WHEN 0 THEN 'translated by' ELSE 'edited by' END || ': N' || p_size % 7 AS "respAll", 'k1 | ' || p_size AS keywords FROM s""")
def index_gretil(spark, sf_dir):
    return _built(spark, sf_dir, "gretil", "author", "translator", "publisher", "date", "idno", "headsPreview", "respAll", "keywords")


@query("index_cbeta", f"""{_ROWS} SELECT 'x' || p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'H1 ' || p_type ELSE p_name END AS title, path, CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE 'X' END AS canon, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END AS nnum, '2' AS "juanCount",
CASE WHEN p_partkey % 3 = 0 THEN 'N' || p_size % 7 END AS translator, {_HEADS} AS "headsPreview", CASE p_partkey % 3 WHEN 0 THEN 'Translated by' ELSE 'Edited by' END || ': N' || p_size % 7 AS "respAll", 'cbeta_index_v2' AS "indexVersion" FROM s""")
def index_cbeta(spark, sf_dir):
    return _built(spark, sf_dir, "cbeta", "canon", "nnum", "juanCount", "translator", "headsPreview", "respAll", "indexVersion")


_PALI_TEI = """concat('<TEI><p rend="nikaya">', CASE p_partkey % 3 WHEN 0 THEN 'Saṃyuttanikāya' WHEN 1 THEN 'Dīghanikāyo' ELSE 'Other' END, '</p><p rend="book">', p_size, '. Book</p><p rend="chapter">Ch ', p_partkey % 30, '</p><div n="', p_size, '" type="vagga"/></TEI>')"""
_FORMS = f"""list_concat([''], [n::VARCHAR, lpad(n::VARCHAR, 2, '0'), lpad(n::VARCHAR, 3, '0'), roman], CASE k WHEN 'SN' THEN [n || '.' || m, lpad(n::VARCHAR, 2, '0') || '.' || lpad(m::VARCHAR, 2, '0'), roman || '.' || m] ELSE [] END)"""


@query("index_tipitaka", f"""{_ROWS}, a AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'SN' WHEN 1 THEN 'DN' END AS k, p_size::BIGINT AS n, p_partkey % 30 AS m FROM s), r AS (SELECT *, {_digit(10, "X", "L", "C")} || {_digit(1, "I", "V", "X")} AS roman FROM a), l AS (SELECT *, {_FORMS} AS forms FROM r),
g AS (SELECT *, flatten(list_transform(forms, lambda f: CASE WHEN f = '' THEN [k, lower(k)] ELSE [k || f, lower(k || f), k || ' ' || f, lower(k || ' ' || f)] END)) AS every FROM l)
SELECT stem AS id, CASE p_partkey % 3 WHEN 0 THEN 'Saṃyuttanikāya' WHEN 1 THEN 'Dīghanikāyo' ELSE 'Other' END || ' · ' || n || '. Book · Ch ' || m AS title, path, k AS alias_prefix, CASE WHEN k IS NOT NULL THEN array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), ' ') END AS alias,
n || '(vagga)' AS sections, '' AS "headsPreview", n || '. Book' AS book FROM g""")
def index_tipitaka(spark, sf_dir):
    return _built(spark, sf_dir, "tipitaka", "alias_prefix", "alias", "sections", "headsPreview", "book", xml=_PALI_TEI)


@query("bibliographies", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Saṃyuttanikāya' WHEN 1 THEN 'Dīghanikāyo' ELSE 'Other' END AS nikaya, p_size || '. Book' AS book, 'Ch ' || p_partkey % 30 AS chapter FROM part""")
def bibliographies(spark, sf_dir):
    read = F.udf(catalog.bibliography, "map<string,string>", useArrow=True)
    return _part(spark, sf_dir, x=_PALI_TEI).select("p_partkey", read("x").alias("b")).select("p_partkey", *[F.col("b")[k].alias(k) for k in ("nikaya", "book", "chapter")])


_HEADED = "concat('<TEI><head>', p_name, ' <hi>', p_size, '</hi> ', chr(10), 'x</head>text<jhead><title>', p_type, '</title></jhead><title>no</title><head></head></TEI>')"


@query("heads", "SELECT p_partkey, [p_name || ' ' || p_size || ' x', p_type] AS nested, [p_name || ' ' || p_size || ' x', ''] AS flat FROM part")
def heads(spark, sf_dir):
    """All heads and titles of parts, and those that Spark reads itself."""
    read = F.udf(markup.nested_heads, "array<string>", useArrow=True)
    return _part(spark, sf_dir, x=_HEADED).select("p_partkey", read("x").alias("nested"), fetch.heads(F.col("x")).alias("flat"))


# --- passages and pages ------------------------------------------------------------------------------------------


@query("fetch_fallbacks", """WITH t AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'a' || p_partkey || '.toc' WHEN 1 THEN 'a' || p_partkey - 1 || '.mul' || p_size WHEN 2 THEN 'b' || p_partkey || 'x' ELSE 'b' || p_partkey - 1 || 'x' || p_size END AS id, p_partkey AS k, p_name AS n, p_size AS z FROM part)
SELECT id, CASE k % 4 WHEN 0 THEN coalesce((SELECT p_name FROM part WHERE p_partkey = k + 1), 'list') WHEN 1 THEN n WHEN 2 THEN CASE WHEN k % 3 = 0 THEN n ELSE coalesce((SELECT p_name FROM part WHERE p_partkey = k + 1), 'raw ' || k) END ELSE n END AS text FROM t""")
def fetch_fallbacks(spark, sf_dir):
    """Lists of contents, blank texts with numbered files, and raw ones."""
    ids = "CASE p_partkey % 4 WHEN 0 THEN concat('a', p_partkey, '.toc') WHEN 1 THEN concat('a', p_partkey - 1, '.mul', p_size) WHEN 2 THEN concat('b', p_partkey, 'x') ELSE concat('b', p_partkey - 1, 'x', p_size) END"
    text = "CASE WHEN p_partkey % 4 = 0 THEN 'list' WHEN p_partkey % 4 = 2 AND p_partkey % 3 <> 0 THEN ' ' ELSE p_name END"
    texts = _part(spark, sf_dir, id=ids, text=text, raw="concat('<p>raw</p> ', p_partkey)").drop("p_partkey")
    return fetch.with_fallbacks(texts.select("id"), texts)


@query("focus_context", rf"""WITH d AS (SELECT doc_id, text, regexp_matches(text, '(?i){PATTERN}') AS hit, len(regexp_replace(regexp_extract(text, '(?is)^(.*?)(?:{PATTERN})', 1), '[^\n]', '', 'g')) + 1 AS k, string_split(regexp_replace(text, '\r?\n$', ''), chr(10)) AS l FROM documents)
SELECT doc_id, left(CASE WHEN hit THEN array_to_string(l[greatest(k - 3, 1):least(k + 20, len(l))], chr(10)) ELSE text END, 6000) AS passage FROM d""")
def focus_context(spark, sf_dir):
    """Lines around the first match, cut to what is fetched at once."""
    return _docs(spark, sf_dir).select("doc_id", fetch.capped(fetch.focus(F.col("text"), PATTERN)).alias("passage"))


@query("pipeline_snippets", _AROUND + rf""",
ctx AS (SELECT t.doc_id, t.line_number, left(string_agg(l.line, chr(10) ORDER BY l.line_number), 120) AS passage FROM three t JOIN lines l ON l.doc_id = t.doc_id AND l.line_number BETWEEN t.line_number - 1 AND t.line_number + 3 GROUP BY ALL)
SELECT doc_id, any_value(total_matches) AS total_matches, regexp_replace(string_agg(passage, chr(10) || '---' || chr(10) ORDER BY line_number), '(?i)({PATTERN})', '>>> \1 <<<', 'g') AS passages FROM ctx JOIN top USING (doc_id) GROUP BY doc_id""")
def pipeline_snippets(spark, sf_dir):
    return search.search_to_context(_docs(spark, sf_dir), PATTERN, "doc_id", snippet=80)


_PAGE = "concat('<html><body><div id=\"menu\">menu ', repeat('m ', 40), '</div>', CASE p_partkey % 4 WHEN 0 THEN concat('<span class=\"tx\"> ', repeat('line ', 12), p_name, ' </span><span class=\"tx\">second</span>') WHEN 1 THEN concat('<span class=\"tx\">short</span><div class=\"b content\">', repeat('word ', 12), p_name, '</div>') WHEN 2 THEN concat('<pre>', repeat('pre ', 15), p_name, '</pre><main>', repeat('in main ', 9), '<br/>', p_name, '</main>') ELSE '<p>tiny</p>' END, '</body></html>')"


@query("sat_pages", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN repeat('line ', 12) || p_name || chr(10) || 'second' WHEN 1 THEN repeat('word ', 12) || p_name WHEN 2 THEN trim(repeat('in main ', 9)) || chr(10) || p_name ELSE 'menu ' || trim(repeat('m ', 40)) || chr(10) || 'tiny' END AS text FROM part""")
def sat_pages(spark, sf_dir):
    """The marked lines of a stored page, else the first place that holds enough, else the page."""
    read = F.udf(hits.article_text, "string", useArrow=True)
    return _part(spark, sf_dir, h=_PAGE).select("p_partkey", read("h").alias("text"))


_DETAIL = "concat('<a class=\"tnbn_prev\" href=\"?lineno=J', p_partkey, '\">p</a>', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('<a class=\"tnbn_next\" href=\"?x=1&amp;lineno=N', p_partkey, '\">n</a>') END, '<p class=\"sdt01\">', CASE WHEN p_partkey % 2 = 0 THEN 'J0012' ELSE 'JX' END, ' ', p_name, ' 画像</p><table class=\"sd_table\"><tr><td class=\"sd_td1\">J', p_partkey, ' :</td><td class=\"sd_td2\"> ', p_type, ' </td></tr><tr><td class=\"sd_td1\"></td><td class=\"sd_td2\">x</td></tr><tr><td class=\"sd_td1\">K</td><td class=\"sd_td2\">', p_brand, '</td></tr></table>')"


@query("jozen_details", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'J0012' ELSE 'JX' END || ' ' || p_name AS header, CASE WHEN p_partkey % 2 = 0 THEN 'J0012' END AS textno, 'J' || p_partkey AS prev, CASE WHEN p_partkey % 3 <> 0 THEN 'N' || p_partkey END AS "next",
['J' || p_partkey, 'K'] AS line_ids, '[J' || p_partkey || '] ' || p_type || chr(10) || '[K] ' || p_brand AS content FROM part""")
def jozen_details(spark, sf_dir):
    p = spread.evenly(_t(spark, sf_dir, "part")).select("p_partkey", F.expr(_DETAIL).alias("h"))
    return p.select("p_partkey", hits.detail_page(F.col("h")).alias("d")).select("p_partkey", "d.header", "d.textno", "d.prev", "d.next", "d.line_ids", "d.content")


@query("probe_pages", """WITH c AS (SELECT p_partkey AS pos, 'u' || p_partkey AS url, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS text FROM part ORDER BY p_partkey LIMIT 5)
SELECT url, pos, text FROM c WHERE text <> '' ORDER BY (NOT contains(text, 'ring'))::INT, pos LIMIT 1""")
def probe_pages(spark, sf_dir):
    """Of the first candidates the one whose stored page holds the query, else the first with a text."""
    p = _part(spark, sf_dir, url="concat('u', p_partkey)", text="CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END")
    return rank.probe(p.select("url", F.col("p_partkey").alias("pos")), p.select("url", "text"), "ring").select("url", "pos", "text")


_LATIN_SYLLABLES = ["bla", "ma", "rgyal", "po", "bkra", "shis", "bde", "legs", "sangs", "brgyad"]
_SCRIPT_SYLLABLES = ["བླ", "མ", "རྒྱལ", "པོ", "བཀྲ", "ཤིས", "བདེ", "ལེགས", "སངས", "བརྒྱད"]


def _syllables(of: list[str], gap: str) -> str:
    every = ", ".join(f"'{s}'" for s in of)
    return f"array_to_string(list_transform([p_partkey % 10, p_size % 10, (p_partkey // 10) % 10], lambda k: ([{every}])[k + 1]), '{gap}')"


@query("tibetan_terms", f"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN [{_syllables(_SCRIPT_SYLLABLES, '་')}] WHEN p_partkey % 4 = 1 THEN ['1'] ELSE [{_syllables(_LATIN_SYLLABLES, ' ')}, {_syllables(_SCRIPT_SYLLABLES, '་')}] END AS terms FROM part""")
def tibetan_terms(spark, sf_dir):
    """What is searched for: a query in transliteration also in Tibetan."""
    p = _t(spark, sf_dir, "part")
    at = F.array(F.col("p_partkey") % 10, F.col("p_size") % 10, F.expr("p_partkey div 10") % 10)
    written = lambda of, gap: F.array_join(F.transform(at, lambda k: F.get(F.array(*[F.lit(s) for s in of]), k)), gap)
    q = F.when(F.col("p_partkey") % 4 == 0, written(_SCRIPT_SYLLABLES, "་")).when(F.col("p_partkey") % 4 == 1, "1").otherwise(written(_LATIN_SYLLABLES, " "))
    return p.select("p_partkey", q.alias("q")).select("p_partkey", tibetan.search_terms(F.col("q")).alias("terms"))
