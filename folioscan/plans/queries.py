"""Queries over the driver's tables: documents stand for corpus files, pages for marked-up files, part and nation for catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import patterns as P
from folioscan.functions import text as T
from folioscan.operators import fetch, rank, requests, search, spread
from folioscan.sources import catalog, hits, readers

PATTERN = "tion the|lich der"
FUZZY = "the and"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir, *columns):
    return _t(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def _values(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# --- line search -------------------------------------------------------------------------------------------------

_LINES = r"""
lines AS (
  SELECT doc_id, source, text, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_number
  FROM (SELECT doc_id, source, text, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\r?\n$', ''), chr(10)) END AS ls FROM documents)
)"""


def _hits(pattern: str) -> str:
    return _LINES + rf""",
hits AS (
  SELECT doc_id, source, line_number::INT AS line_number, rtrim(line, ' ' || chr(9) || chr(13)) AS context, regexp_extract(line, '(?i)({pattern})', 1) AS highlight
  FROM lines WHERE regexp_matches(line, '(?i){pattern}')
),
capped AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_number) <= 5),
counted AS (SELECT doc_id, any_value(source) AS source, count(*)::INT AS total_matches, min(line_number)::INT AS line_number, arg_min(highlight, line_number) AS highlight FROM capped GROUP BY doc_id)"""


@query("grep_lines", f"WITH {_hits(PATTERN)} SELECT doc_id, line_number, context, highlight FROM hits")
def grep_lines(spark, sf_dir):
    return search.hits(_docs(spark, sf_dir), PATTERN, "doc_id")


@query("grep_capped", f"WITH {_hits(PATTERN)} SELECT doc_id, line_number, context, highlight FROM capped")
def grep_capped(spark, sf_dir):
    return search.hits(_docs(spark, sf_dir), PATTERN, "doc_id", most=5)


def _found(spark, sf_dir, pattern=PATTERN):
    return search.grep(_docs(spark, sf_dir, "source"), pattern)


def _first(df):
    m = F.col("matches")[0]
    return df.select("doc_id", "total_matches", m["line_number"].alias("line_number"), m["highlight"].alias("highlight"))


@query("grep_best_first", f"WITH {_hits(PATTERN)} SELECT doc_id, total_matches, line_number, highlight FROM counted ORDER BY total_matches DESC, doc_id LIMIT 20")
def grep_best_first(spark, sf_dir):
    return _first(search.best_first(_found(spark, sf_dir), "doc_id"))


@query("grep_path_order", f"WITH {_hits(PATTERN)} SELECT doc_id, total_matches, line_number, highlight FROM counted ORDER BY doc_id LIMIT 20")
def grep_path_order(spark, sf_dir):
    return _first(search.path_order(_found(spark, sf_dir), "doc_id"))


@query("grep_tiered", f"WITH {_hits(PATTERN)} SELECT doc_id, total_matches, line_number, highlight, (source <> 'src0')::INT AS tier FROM counted ORDER BY tier, total_matches DESC, doc_id LIMIT 20")
def grep_tiered(spark, sf_dir):
    found = search.tiered(_found(spark, sf_dir), F.when(F.col("source") == "src0", 0).otherwise(1), "doc_id")
    m = F.col("matches")[0]
    return found.select("doc_id", "total_matches", m["line_number"].alias("line_number"), m["highlight"].alias("highlight"), "tier")


@query("grep_ws_fuzzy", f"WITH {_hits('the' + chr(92) + 's*and')} SELECT doc_id, total_matches, line_number, highlight FROM counted")
def grep_ws_fuzzy(spark, sf_dir):
    return _first(_found(spark, sf_dir, P.compile_query(FUZZY)))


_IN_SCRIPT = "translate(text, 'aeo', '法華经')"
_SCRIPT = r"\p{Han}\p{Ll}+\p{Han}|[^\p{Han}\p{L}\s.,]\p{Han}"


@query("grep_script_class", f"WITH md AS (SELECT * REPLACE ({_IN_SCRIPT} AS text) FROM documents), {_hits(_SCRIPT).replace('FROM documents', 'FROM md')} SELECT doc_id, total_matches, line_number, highlight FROM counted")
def grep_script_class(spark, sf_dir):
    """Classes of scripts and letters, over the documents with three of their letters written as ideographs."""
    d = _docs(spark, sf_dir, "source").withColumn("text", F.expr(_IN_SCRIPT))
    return _first(search.grep(d, _SCRIPT))


_VARIED = "replace(replace(replace(replace(text, ' the ', ' 妙法 蓮華経 '), ' of ', ' 妙法蓮華经 '), ' der ', ' 妙法蓮華經 '), ' de ', ' 仏国 ')"


@query("grep_variant_class", rf"SELECT doc_id, len(regexp_extract_all({_VARIED}, '妙法\s*蓮華[經経经]'))::INT AS n, regexp_matches({_VARIED}, '[佛仏][國国]') AS country FROM documents")
def grep_variant_class(spark, sf_dir):
    """Characters that stand for one another, over the documents with some of their words written so."""
    text = F.expr(_VARIED)
    sutra, country = (P.java_pattern(P.compile_query(q, need_space=False, variants=True)) for q in ("妙法 蓮華經", "佛國"))
    return _docs(spark, sf_dir).select("doc_id", F.regexp_count(text, F.lit(sutra)).alias("n"), text.rlike(country).alias("country"))

@query("size_hints", "SELECT doc_id, floor(strlen(text) / 1024)::BIGINT || 'KB' AS size FROM documents")
def size_hints(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", search.size_hint(F.col("text")).alias("size"))


@query("grep_summary", f"""WITH {_hits(PATTERN)}, s AS (SELECT doc_id, list(substr(context, 1, 100) ORDER BY line_number)[1:2] AS two, count(*) AS n FROM capped GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), array_to_string(two, chr(10)), CASE WHEN n > 2 THEN '... and ' || (n - 2) || ' more' END) AS summary FROM s""")
def grep_summary(spark, sf_dir):
    return search.summary(_found(spark, sf_dir)).select("doc_id", "summary")


# --- normalisation and similarity --------------------------------------------------------------------------------

_NORM = r"regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]', '', 'g')"
# a decomposed mark is neither letter nor number, so it separates
_SPACED = r"trim(regexp_replace(lower(array_to_string(list_transform(string_split({0}, ''), lambda x: CASE WHEN strip_accents(x) <> x THEN strip_accents(x) || ' ' ELSE x END), '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("norm_text", f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalised(F.col("text")).alias("norm"))


@query("norm_spaces", f"SELECT doc_id, {_SPACED.format('text')} AS spaced FROM documents")
def norm_spaces(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalised_spaces(F.col("text")).alias("spaced"))


@query("token_sets", f"SELECT doc_id, len(list_distinct(list_filter(string_split({_SPACED.format('text')}, ' '), lambda x: x <> '')))::BIGINT AS tokens FROM documents")
def token_sets(spark, sf_dir):
    spaced = _docs(spark, sf_dir).withColumn("spaced", T.normalised_spaces(F.col("text")))
    return spaced.select("doc_id", F.size(T.token_set(F.col("spaced"))).cast("long").alias("tokens"))


TITLE = "green widget 12"
_Q, _QW = "greenwidget12", "green widget 12"


def _bigrams(x: str) -> str:
    return f"(CASE WHEN strlen({x}) >= 2 THEN list_distinct(list_transform(range(0, (strlen({x}) - 1)::BIGINT), lambda i: substr(hex({x}), (2 * i + 1)::BIGINT, 4))) ELSE []::VARCHAR[] END)"


def _jac(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) - {inter} > 0 THEN {inter}::DOUBLE / (len({a}) + len({b}) - {inter}) ELSE 0.0 END)"


_PART = rf"""
p AS (SELECT p_partkey AS id, p_name, p_brand, {_NORM.format("p_name")} AS nm, {_SPACED.format("p_name")} AS ws FROM part),
f AS (SELECT *, {_bigrams("nm")} AS a, {_bigrams(f"'{_Q}'")} AS b, list_distinct(list_filter(string_split(ws, ' '), lambda x: x <> '')) AS ta, ['green', 'widget', '12'] AS tb FROM p),
j AS (SELECT *, {_jac("a", "b")} AS cj, {_jac("ta", "tb")} AS tj, regexp_matches(nm, '{"".join(f"[^{c}]*{c}" for c in _Q)}') AS ordered,
  contains('{_Q}', nm) OR nm = '' AS held FROM f)"""


def _part(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    return p


@query("jaccard_bytes", f"WITH {_PART} SELECT id, round(cj, 6) AS score FROM j")
def jaccard_bytes(spark, sf_dir):
    return _catalogue(spark, sf_dir).select("id", F.round(T.byte_jaccard(F.col("hay_norm"), F.lit(_Q)), 6).alias("score"))


@query("token_jaccard", f"WITH {_PART} SELECT id, round(tj, 6) AS score FROM j")
def token_jaccard(spark, sf_dir):
    tokens = F.array(*[F.lit(t) for t in _QW.split()])
    return _catalogue(spark, sf_dir).select("id", F.round(T.token_jaccard(T.token_set(F.col("hay_ws")), tokens), 6).alias("score"))


@query("subsequence", r"SELECT doc_id, regexp_matches(text, '(?s)^[^s]*s[^h]*h[^e]*e[^ ]* [^t]*t') AS ordered FROM documents")
def subsequence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.contains_in_order(F.col("text"), "she t").alias("ordered"))


def _inverse(nm: str) -> str:
    """SQL: whether nm is a subsequence of the query: what is left of nm after the query's characters took theirs."""
    return f"(list_reduce(list_concat([{nm}], string_split('{_Q}', '')), lambda rest, c: CASE WHEN starts_with(rest, c) THEN substr(rest, 2) ELSE rest END) = '')"


_BASE = f"round(CASE WHEN greatest(cj, tj) < 0.95 AND (ordered OR {_inverse('nm')}) THEN greatest(cj, tj, 0.85) ELSE greatest(cj, tj) END, 6)"
_MATCH = f"CASE WHEN contains(nm, '{_Q}') THEN 1.0 WHEN greatest(cj, tj) < 0.95 AND (ordered OR {_inverse('nm')}) THEN greatest(cj, tj, 0.85) ELSE greatest(cj, tj) END"


@query("title_score", f"WITH {_PART} SELECT id, {_BASE} AS score FROM j")
def title_score(spark, sf_dir):
    return rank.scored_titles(_part(spark, sf_dir), "p_name", TITLE).select("id", "score")


def _catalogue(spark, sf_dir):
    return rank.with_hay(_part(spark, sf_dir), F.col("p_name"))


@query("title_search_topk", f"WITH {_PART} SELECT id, p_name, round(CASE WHEN contains(ws, '{_QW}') THEN least({_MATCH} + 0.05, 1.0) ELSE {_MATCH} END, 6) AS score FROM j ORDER BY score DESC, id LIMIT 10")
def title_search_topk(spark, sf_dir):
    return rank.title_search(_catalogue(spark, sf_dir), TITLE).select("id", "p_name", "score")


@query("title_search_contributor_boost", f"""WITH {_PART}, b AS (SELECT id, {_NORM.format("p_brand")} AS nb, {_MATCH} AS s, ws FROM j)
SELECT id, round(CASE WHEN nb <> '' AND (contains(nb, 'brand1') OR contains('brand1', nb)) THEN greatest(s, 0.93) ELSE s END, 6) AS score FROM b""")
def title_search_contributor_boost(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    score = rank.base_score(F.col("hay_norm"), F.col("hay_ws"), TITLE)
    return c.select("id", F.round(rank.contributor_boost(score, [F.col("p_brand")], "Brand#1"), 6).alias("score"))


@query("numeric_boost", f"WITH {_PART} SELECT id, contains(ws, '12') AS boosted FROM j")
def numeric_boost(spark, sf_dir):
    return _catalogue(spark, sf_dir).select("id", F.col("hay_ws").contains(T.python_normalised_spaces("12")).alias("boosted"))


# --- resolving ---------------------------------------------------------------------------------------------------

_NATION_Q = "nation 12"


@query("resolve_union_dedupe", f"""
WITH c AS (
  SELECT 'nation' AS source, n_name AS id, n_name AS title, 0 AS seq FROM nation UNION ALL SELECT 'region', r_name, r_name, 1 FROM region UNION ALL SELECT 'nation', n_name, n_name, 2 FROM nation
), n AS (SELECT *, {_NORM.format("title")} AS nm, {_SPACED.format("title")} AS ws FROM c),
f AS (SELECT *, {_bigrams("nm")} AS a, {_bigrams("'nation12'")} AS b, list_distinct(list_filter(string_split(ws, ' '), lambda x: x <> '')) AS ta, ['nation', '12'] AS tb FROM n),
s AS (SELECT *, round(greatest({_jac("a", "b")}, {_jac("ta", "tb")}), 6) AS j0, regexp_matches(nm, '{"".join(f"[^{x}]*{x}" for x in "nation12")}') AS o1,
  list_reduce(list_concat([nm], string_split('nation12', '')), lambda rest, x: CASE WHEN starts_with(rest, x) THEN substr(rest, 2) ELSE rest END) = '' AS o2 FROM f),
g AS (SELECT source, id, title, seq, CASE WHEN j0 < 0.95 AND (o1 OR o2) THEN greatest(j0, 0.85) ELSE j0 END AS score FROM s),
k AS (SELECT * FROM g WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, id) <= 5),
r AS (SELECT *, round(score + CASE WHEN source = 'region' THEN 0.02 ELSE 0 END, 6) AS rank_score FROM k),
d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY rank_score DESC, seq) = 1)
SELECT source, id, title, score, rank_score FROM d ORDER BY rank_score DESC, seq, id LIMIT 10""")
def resolve_union_dedupe(spark, sf_dir):
    def cand(table, column, source):
        t = _t(spark, sf_dir, table).select(F.lit(source).alias("source"), F.col(column).alias("id"), F.col(column).alias("title"))
        return rank.scored_titles(t, "title", _NATION_Q)

    per = [cand("nation", "n_name", "nation"), cand("region", "r_name", "region"), cand("nation", "n_name", "nation")]
    return rank.resolve(spark, per, preferred="region").select("source", "id", "title", "score", "rank_score")


_ALIASES = [("heart", "般若心経"), ("heart", "Heart Sutra"), ("diamond", "金剛経"), ("diamond", "Diamond Sutra"), ("lotus", "Lotus Sutra"), ("the", "the"), ("passage", "tion the")]


@query("crosswalk_theta", f"""WITH a(key, alias) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _ALIASES if v.isascii())}),
n AS (SELECT key, {_NORM.format("alias")} AS na FROM a), q AS (SELECT item_id, {_NORM.format("text")} AS nq FROM benchmark)
SELECT DISTINCT item_id, key FROM q JOIN n ON na = nq OR (strlen(nq) >= 6 AND (contains(na, nq) OR contains(nq, na)))""")
def crosswalk_theta(spark, sf_dir):
    q = _t(spark, sf_dir, "benchmark").select("item_id", T.normalised(F.col("text")).alias("nq"))
    a = _values(spark, "key string, na string", [(k, T.python_normalised(v)) for k, v in _ALIASES if v.isascii()])
    return rank.crosswalk(q, a).select("item_id", "key")


_SHAPES = "CASE c_custkey % 13 WHEN 0 THEN concat('T', c_custkey) WHEN 1 THEN concat(' t', c_custkey, ' ') WHEN 2 THEN concat('dn', c_custkey) WHEN 3 THEN concat('mn ', c_custkey) WHEN 4 THEN concat('AN', c_custkey, '.3') WHEN 5 THEN 'KN' WHEN 6 THEN concat('s0', c_custkey, 'm.mul') WHEN 7 THEN concat('J0', c_custkey % 10, '_', c_custkey) WHEN 8 THEN concat('J', c_custkey, '_0') WHEN 9 THEN concat('sa_', c_name) WHEN 10 THEN concat('2,', c_custkey, ',38') WHEN 11 THEN concat('2,', c_name) ELSE '' END"


@query("detect_source", f"""WITH v AS (SELECT c_custkey, {_SHAPES} AS i FROM customer) SELECT c_custkey, CASE WHEN regexp_matches(upper(trim(i)), '^T[0-9]') THEN 'cbeta' WHEN regexp_matches(upper(trim(i)), '^(DN|MN|SN|AN|KN)[0-9]') THEN 'tipitaka' WHEN contains(i, '.mul') THEN 'tipitaka'
WHEN regexp_matches(upper(trim(i)), '^J[0-9]{{2}}_') THEN 'jozen' WHEN starts_with(trim(i), 'sa_') THEN 'gretil' WHEN contains(i, ',') AND regexp_full_match(trim(i), '[0-9,]+') THEN 'sat' END AS source FROM v""")
def detect_source(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", T.detect_source(F.expr(_SHAPES)).alias("source"))

@query("lookup_ids", """WITH w AS (SELECT DISTINCT substr(c_name, 1, 12) AS wanted_id FROM customer UNION SELECT DISTINCT lower(s_name) FROM supplier UNION SELECT 'none'),
c AS (SELECT c_name AS id, c_name || '.xml' AS path FROM customer UNION ALL SELECT s_name, s_name || '.xml' FROM supplier),
m AS (SELECT wanted_id, 0 AS prio, id, path FROM w JOIN c ON wanted_id = id UNION ALL SELECT wanted_id, 1, id, path FROM w JOIN c ON lower(wanted_id) = lower(id)
  UNION ALL SELECT wanted_id, 2, id, path FROM w JOIN c ON 'sa_' || wanted_id = id UNION ALL SELECT wanted_id, 3, id, path FROM w JOIN c ON lower(wanted_id) = lower(regexp_replace(id, '[0-9]+$', '')))
SELECT wanted_id, path FROM m QUALIFY row_number() OVER (PARTITION BY wanted_id ORDER BY prio, coalesce(TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT), 0), path) = 1""")
def lookup_ids(spark, sf_dir):
    c, s = (_t(spark, sf_dir, n).select(F.col(k).alias("id")) for n, k in (("customer", "c_name"), ("supplier", "s_name")))
    wanted = c.select(F.substring("id", 1, 12).alias("wanted_id")).union(s.select(F.lower("id"))).union(_values(spark, "x string", [("none",)])).distinct()
    return rank.lookup(c.union(s).withColumn("path", F.concat("id", F.lit(".xml"))), wanted)


# --- passages ----------------------------------------------------------------------------------------------------


@query("line_context", rf"""WITH d AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\r?\n$', ''), chr(10)) END AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) >= 3 THEN array_to_string(ls[2:least(5, len(ls))], chr(10)) ELSE '' END AS passage FROM d""")
def line_context(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fetch.context_lines(F.col("text"), F.lit(3), 1, 2).alias("passage"))


@query("char_slice_page", "SELECT doc_id, substr(text, least(400, length(text)) + 1, greatest(0, least(600, length(text)) - least(400, length(text)))) AS slice, length(text)::INT AS total, least(400, length(text))::INT AS \"start\", greatest(least(400, length(text)), least(600, length(text)))::INT AS \"end\" FROM documents")
def char_slice_page(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fetch.char_slice(F.col("text"), page=2, page_size=200).alias("s")).select("doc_id", "s.*")


@query("highlight_count", f"SELECT doc_id, len(regexp_extract_all(text, '(?i){PATTERN}'))::INT AS n FROM documents")
def highlight_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fetch.highlight_count(F.col("text"), PATTERN).alias("n"))


@query("highlight_markup", rf"SELECT doc_id, regexp_replace(text, '(?i)({PATTERN})', '>>> \1 <<<', 'g') AS marked FROM documents")
def highlight_markup(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fetch.highlight(F.col("text"), PATTERN).alias("marked"))


@query("highlight_positions", """SELECT doc_id, list_aggregate(list_transform(range(1, len(string_split(text, 'tion'))::BIGINT), lambda i: length(array_to_string(string_split(text, 'tion')[1:i], 'tion'))), 'sum')::BIGINT AS starts,
(len(string_split(text, 'tion')) - 1)::INT AS n FROM documents""")
def highlight_positions(spark, sf_dir):
    at = fetch.highlight_positions("tion", is_regex=False)(F.col("text"))
    d = _docs(spark, sf_dir).withColumn("at", at)
    total = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x["start_char"])
    return d.select("doc_id", F.when(F.size("at") > 0, total).alias("starts"), F.size("at").alias("n"))


@query("focus_offsets", f"SELECT doc_id, greatest(0, CASE WHEN regexp_matches(text, '(?i){PATTERN}') THEN length(regexp_extract(text, '(?is)^(.*?)(?:{PATTERN})', 1)) - 50 ELSE 0 END)::INT AS \"start\" FROM documents")
def focus_offsets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fetch.focus_offset(F.col("text"), PATTERN).alias("start"))


_MARKED_LINE = "CASE WHEN {0} % 3 = 0 THEN concat('<lb ed=\"x\" n = ', chr(39), {0}, 'a', chr(39), '/>', x) ELSE x END"
#: The documents with a marker at the beginning of every third line, for DuckDB and for Spark.
_EVERY_THIRD = f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_MARKED_LINE.format('i')}), chr(10))", f"array_join(transform(split(text, chr(10)), (x, i) -> {_MARKED_LINE.format('(i + 1)')}), chr(10))"


@query("anchor_asof", f"""WITH md AS (SELECT * REPLACE ({_EVERY_THIRD[0]} AS text) FROM documents), {_hits(PATTERN).replace('FROM documents', 'FROM md')},
m AS (SELECT doc_id, line_number AS begins, regexp_extract(line, 'n = .([0-9]+a)', 1) AS n FROM lines WHERE contains(line, '<lb ')), f AS (SELECT doc_id, arg_min(n, begins) AS n FROM m GROUP BY doc_id)
SELECT hits.doc_id, line_number, coalesce(m.n, f.n) AS lb FROM hits ASOF LEFT JOIN m ON hits.doc_id = m.doc_id AND hits.line_number >= m.begins LEFT JOIN f ON f.doc_id = hits.doc_id""")
def anchor_asof(spark, sf_dir):
    """The marker that holds at each matching line: an as-of join with the index of marks."""
    d = _docs(spark, sf_dir).withColumn("text", F.expr(_EVERY_THIRD[1]))
    places = search.hits(d, PATTERN, "doc_id").select(F.col("doc_id").alias("id"), F.col("line_number").alias("line"))
    near = requests.nearest_markers(places, requests.index(d, "doc_id"))
    return near.select(F.col("id").alias("doc_id"), F.col("line").alias("line_number"), "lb")

# --- pages -------------------------------------------------------------------------------------------------------

_TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"


@query("page_titles", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.collapse_spaces(F.regexp_extract("html", _TITLE, 1)).alias("title"))


@query("page_heads", r"SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1), lambda h: trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS heads FROM pages")
def page_heads(spark, sf_dir):
    inner = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return _t(spark, sf_dir, "pages").select("page_id", F.transform(inner, lambda h: T.collapse_spaces(F.regexp_replace(h, "<[^>]+>", ""))).alias("heads"))


@query("section_by_head", r"""WITH x AS (SELECT page_id, replace(replace(html, '<h1', '<head'), '</h1>', '</head>') AS xml FROM pages)
SELECT page_id, CASE WHEN regexp_matches(xml, '(?is)<head\b[^>]*>.*?</head>') THEN string_split_regex(xml, '(?is)<head\b[^>]*>.*?</head>')[2] END AS section FROM x""")
def section_by_head(spark, sf_dir):
    xml = F.replace(F.replace(F.col("html"), F.lit("<h1"), F.lit("<head")), F.lit("</h1>"), F.lit("</head>"))
    return _t(spark, sf_dir, "pages").select("page_id", fetch.section_by_head(xml, index=0).alias("section"))


def _unescaped(c: str) -> str:
    """SQL: the entities that the pages hold; the ampersand last, so that nothing is decoded twice."""
    for name, sign in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{sign}')"
    return c


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"

@query("page_plain_text", rf"SELECT page_id, trim(regexp_replace({_unescaped(_BARE)}, '\s+', ' ', 'g')) AS text FROM pages")
def page_plain_text(spark, sf_dir):
    from folioscan.functions.markup import visible_text

    plain = F.pandas_udf(lambda s: s.map(visible_text), "string")
    return _t(spark, sf_dir, "pages").select("page_id", plain("html").alias("text"))


_HEAD_TEXT = r"regexp_replace(regexp_extract(html, '(?s)<head\b[^>]*>(.*?)</head>', 1), '<[^>]+>', '', 'g')"
_URL_STEM = r"regexp_replace(regexp_extract(url, '[^/]*$'), '[.][^.]*$', '')"


@query("page_index", rf"SELECT {_URL_STEM} AS id, coalesce(nullif(trim(regexp_replace({_unescaped(_HEAD_TEXT)}, '\s+', ' ', 'g')), ''), {_URL_STEM}) AS title, url AS path FROM pages")
def page_index(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    built = catalog.build(pages, "plain")
    return built.select("id", "title", "path")


_LATIN = r"regexp_replace(text, '[^\x{0}-\x{7F}\x{A0}-\x{FF}]', '?', 'g')"


@query("decode_bytes", f"SELECT doc_id, text AS utf8, text AS utf16, {_LATIN} AS undeclared, '<?xml encoding=\"iso-8859-1\"?>' || {_LATIN} AS declared FROM documents")
def decode_bytes(spark, sf_dir):
    """Of the texts' bytes in four encodings: by a byte order mark, by what is declared, as UTF-8, and what isn't that."""
    latin = F.regexp_replace("text", r"[^\x{0}-\x{7F}\x{A0}-\x{FF}]", "?")
    written = {"utf8": F.encode("text", "UTF-8"), "utf16": F.encode("text", "UTF-16"), "undeclared": F.encode(latin, "ISO-8859-1"), "declared": F.encode(F.concat(F.lit('<?xml encoding="iso-8859-1"?>'), latin), "ISO-8859-1")}
    return _docs(spark, sf_dir).select("doc_id", *[readers.decode_lossy(c).alias(name) for name, c in written.items()])


@query("url_lineno", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_lineno(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.query_parameter(F.col("url"), "page").alias("page"))


# --- pipelines ---------------------------------------------------------------------------------------------------

_AROUND = f"""WITH {_hits(PATTERN)},
top AS (SELECT doc_id, least(total_matches, 3)::INT AS total_matches FROM counted ORDER BY least(total_matches, 3) DESC, doc_id LIMIT 10),
three AS (SELECT doc_id, line_number FROM capped JOIN top USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_number) <= 3)"""


@query("pipeline_context", _AROUND + rf""",
ctx AS (SELECT t.doc_id, t.line_number, string_agg(l.line, chr(10) ORDER BY l.line_number) AS passage FROM three t JOIN lines l ON l.doc_id = t.doc_id AND l.line_number BETWEEN t.line_number - 1 AND t.line_number + 3 GROUP BY ALL)
SELECT doc_id, any_value(total_matches) AS total_matches, regexp_replace(string_agg(passage, chr(10) || '---' || chr(10) ORDER BY line_number), '(?i)({PATTERN})', '>>> \1 <<<', 'g') AS passages FROM ctx JOIN top USING (doc_id) GROUP BY doc_id""")
def pipeline_context(spark, sf_dir):
    return search.search_to_context(_docs(spark, sf_dir), PATTERN, "doc_id")


@query("context_join", _AROUND + """
SELECT t.doc_id, t.line_number, string_agg(l.line, chr(10) ORDER BY l.line_number) AS passage FROM three t JOIN lines l ON l.doc_id = t.doc_id AND l.line_number BETWEEN t.line_number - 1 AND t.line_number + 3 GROUP BY ALL""")
def context_join(spark, sf_dir):
    d = _docs(spark, sf_dir)
    best = search.best_first(search.grep(d, PATTERN, 3), "doc_id", 10)
    wanted = best.select("doc_id", F.inline("matches")).select("doc_id", "line_number")
    return search.context(d, wanted, "doc_id", 1, 3).select("doc_id", "line_number", "passage")


@query("fetch_suggestions", f"WITH {_hits(PATTERN)} SELECT doc_id, line_number, greatest(line_number - 1, 1)::INT AS from_line, (line_number + 3)::INT AS to_line FROM counted ORDER BY total_matches DESC, doc_id LIMIT 5")
def fetch_suggestions(spark, sf_dir):
    return search.suggestions(_found(spark, sf_dir), "doc_id", top=5)


# --- lists of hits -----------------------------------------------------------------------------------------------


@query("titles_distinct_paged", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name ORDER BY p_partkey LIMIT 10 OFFSET 5")
def titles_distinct_paged(spark, sf_dir):
    return rank.distinct_paged(_t(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey", 10, 5)


_BODY = "concat(p_type, ' green Widget 1', p_partkey % 40)"


@query("sat_tier_pick", f"""WITH {_PART.replace("SELECT p_partkey AS id, p_name, p_brand,", f"SELECT p_partkey AS id, {_BODY} AS body, p_name, p_brand,")},
t AS (SELECT id AS pos, CASE WHEN contains({_NORM.format("body")}, '{_Q}') THEN 0 WHEN contains(nm, '{_Q}') THEN 1 ELSE 2 END AS tier, {_BASE} AS score FROM j)
SELECT pos, tier FROM t ORDER BY tier, CASE WHEN tier = 2 THEN -score ELSE 0 END, pos LIMIT 200""")
def sat_tier_pick(spark, sf_dir):
    """Candidates in the order in which they are picked."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_name", F.expr(_BODY).alias("body"))
    return rank.pick_by_tier(docs, TITLE, "body", "p_name", "pos").select("pos", "tier").limit(200)

@query("tibetan_merge", """WITH h AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS title, (page_id % 7)::DOUBLE AS score, (page_id % 2)::INT AS backend, page_id AS pos FROM pages)
SELECT url, title, score FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY url ORDER BY backend, pos) = 1) ORDER BY score DESC, backend, pos LIMIT 20""")
def tibetan_merge(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("title"), (F.col("page_id") % 7).cast("double").alias("score"), F.col("page_id").alias("pos"))
    return rank.merge_by_url([p.filter("pos % 2 = 0"), p.filter("pos % 2 = 1")], 20, by_score=True).select("url", "title", "score")


def _digit(place: int, one: str, five: str, ten: str) -> str:
    """SQL: the numeral of one decimal place."""
    forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    return f"([{', '.join(repr(f) for f in forms)}])[(n // {place}) % 10 + 1]"


@query("roman_alias", f"""SELECT DISTINCT n, CASE WHEN n BETWEEN 1 AND 3999 THEN repeat('M', (n // 1000)::INT) || {_digit(100, "C", "D", "M")} || {_digit(10, "X", "L", "C")} || {_digit(1, "I", "V", "X")} ELSE n::VARCHAR END AS roman
FROM (SELECT o_orderkey % 5000 AS n FROM orders)""")
def roman_alias(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("n")).distinct().select("n", T.roman(F.col("n")).alias("roman"))


@query("cjk_ratio", r"""WITH t AS (SELECT doc_id, translate(text, 'aeo', '法華经') AS t FROM documents), n AS (SELECT doc_id, length(regexp_replace(t, '\s', '', 'g')) AS n, length(regexp_replace(t, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]', '', 'g')) AS c FROM t)
SELECT doc_id, CASE WHEN n > 0 THEN round(c::DOUBLE / n, 6) ELSE 0.0 END AS ratio FROM n""")
def cjk_ratio(spark, sf_dir):
    """Of the documents with three of their letters written as ideographs."""
    return _docs(spark, sf_dir).select("doc_id", F.round(T.cjk_ratio(F.translate("text", "aeo", "法華经")), 6).alias("ratio"))


_CANDIDATE = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat('妙法', p_name) WHEN 2 THEN concat('Taishō Tripitaka ', p_name) WHEN 3 THEN '法華經' ELSE concat('Canon of ', p_name) END"
_LANG = "CASE p_partkey % 3 WHEN 0 THEN 'zh-Hant' WHEN 1 THEN 'en' END"
_LEVEL = "CASE p_partkey % 7 WHEN 0 THEN 'm' WHEN 1 THEN 's' END"


@query("header_title_pick", rf"""WITH c AS (SELECT p_partkey // 8 AS work, p_partkey AS pos, {_CANDIDATE} AS t, {_LANG} AS lang, {_LEVEL} AS level FROM part),
r AS (SELECT *, length(regexp_replace(t, '\s', '', 'g')) AS n, length(regexp_replace(t, '[^\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}]', '', 'g')) AS cjk FROM c),
s AS (SELECT work, pos, t, (CASE WHEN lang IS NULL THEN 0.0 WHEN starts_with(lang, 'zh') THEN 3.0 ELSE 0.5 END)::DOUBLE + 2 * (CASE WHEN n > 0 THEN cjk::DOUBLE / n ELSE 0.0 END)::DOUBLE + (CASE level WHEN 'm' THEN 5.0 WHEN 's' THEN -5.0 ELSE 0.0 END)::DOUBLE
  - (CASE WHEN regexp_matches({_NORM.format("t")}, 'tripitaka|taisho|canon') THEN 2.0 ELSE 0.0 END)::DOUBLE + least(length(t), 30)::DOUBLE / 100 AS score FROM r)
SELECT work, t AS title FROM s QUALIFY row_number() OVER (PARTITION BY work ORDER BY score DESC, pos) = 1""")
def header_title_pick(spark, sf_dir):
    """Of the titles of a header the one that names the work."""
    t = _t(spark, sf_dir, "part").selectExpr("p_partkey div 8 AS work", "p_partkey AS pos", f"{_CANDIDATE} AS text", f"{_LANG} AS lang", f"{_LEVEL} AS level")
    score = catalog.title_rank_column(F.col("text"), F.col("lang"), F.col("level"))
    return t.withColumn("score", score).groupBy("work").agg(F.max_by("text", F.struct("score", -F.col("pos"))).alias("title"))

@query("profile_percentiles", """WITH s AS (SELECT list(value ORDER BY value) AS v, count(value) AS n, min(value) AS lo, round(avg(value), 6) AS mean, max(value) AS hi FROM events WHERE value IS NOT NULL)
SELECT n, lo AS "min", mean, hi AS "max", v[(round(0.5 * (n - 1)) + 1)::INT] AS p50, v[(round(0.9 * (n - 1)) + 1)::INT] AS p90, v[(round(0.95 * (n - 1)) + 1)::INT] AS p95, v[(round(0.99 * (n - 1)) + 1)::INT] AS p99 FROM s""")
def profile_percentiles(spark, sf_dir):
    return rank.percentiles(_t(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("spill_preview", "SELECT doc_id, length(text) > 12000 AS spilled, CASE WHEN length(text) > 12000 THEN substr(text, 1, 1200) ELSE text END AS shown FROM documents")
def spill_preview(spark, sf_dir):
    return search.spill(_docs(spark, sf_dir), "text").select("doc_id", "spilled", "shown")


_VERSION = "CASE WHEN p_brand IN ('Brand#11', 'Brand#5') AND p_size < 3 THEN 'v0' ELSE 'cbeta_index_v2' END"
_PATH = "concat(lpad(cast(p_size AS varchar(9)), 3, '0'), '/', lpad(cast(p_partkey AS varchar(9)), 9, '0'), '.xml')"


@query("index_validity", f"""WITH i AS (SELECT p_brand, {_PATH} AS path, {_VERSION} AS version, NOT (p_size = 1 AND p_partkey % 40 = 0) AS there, p_size = 2 AND p_partkey % 97 = 0 AS bare FROM part),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY path) <= 10)
SELECT p_brand, count(*) AS checked, count(*) FILTER (there AND NOT bare AND version = 'cbeta_index_v2') AS sound, bool_and(there AND NOT bare AND version = 'cbeta_index_v2') AS valid FROM f GROUP BY p_brand""")
def index_validity(spark, sf_dir):
    """Each brand's parts are a stored index: some lack files, versions or metadata."""
    part = _t(spark, sf_dir, "part")
    index = part.select("p_brand", F.expr(_PATH).alias("path"), F.expr(f"CASE WHEN NOT (p_size = 2 AND p_partkey % 97 = 0) THEN map('indexVersion', {_VERSION}) END").alias("meta"))
    return catalog.validity(index, part.filter("NOT (p_size = 1 AND p_partkey % 40 = 0)").select(F.expr(_PATH).alias("path")), "cbeta", ("p_brand",))

@query("conversation_context", """SELECT conv_id, turn, text, string_agg(text, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS context FROM conversations""")
def conversation_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 0)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array_join(F.collect_list("text").over(w), " / ").alias("context"))


_TURTLE = "concat('bdr:M', c_custkey, ' a :Instance ; ', CASE WHEN c_custkey % 11 = 0 THEN ':other bdr:C' ELSE ':inRootInstance' END, ' bdr:W', c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' .' WHEN 1 THEN concat(', bdr:W', c_custkey % 7, ' ; :x bdr:B .') WHEN 2 THEN concat(',', chr(10), ' bdr:W_', c_custkey % 3, ' , bdr:W', c_custkey, ' . :y bdr:W3 ; .') ELSE '-1 ; skos:prefLabel x@bo .' END)"


@query("turtle_values", f"""WITH v AS (SELECT c_custkey, {_TURTLE} AS ttl FROM customer), t AS (SELECT c_custkey, substr(ttl, strpos(ttl, ':inRootInstance') + 15) AS rest, contains(ttl, ':inRootInstance') AS has FROM v),
w AS (SELECT c_custkey, CASE WHEN has THEN string_split_regex(CASE WHEN contains(rest, ';') THEN split_part(rest, ';', 1) ELSE split_part(rest, '.', 1) END, '[^A-Za-z0-9:_]') ELSE [] END AS w FROM t),
f AS (SELECT c_custkey, list_transform(list_filter(w, lambda x: starts_with(x, 'bdr:') AND length(x) > 4), lambda x: substr(x, 5)) AS f FROM w)
SELECT c_custkey, list_filter(f, lambda x, i: list_position(f, x) = i) AS found FROM f""")
def turtle_values(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", hits.turtle_values(F.expr(_TURTLE), ":inRootInstance").alias("found"))


_TREE = """concat('{"tree":[{"path":"P', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/base/v2' ELSE '.opf/base/v2' END, '.txt"},{"path":"README.md"},{"path":"P', p_partkey, '.opf/base/v1', CASE WHEN p_partkey % 4 = 0 THEN '.json' ELSE '.txt' END, '"},{"path":"P.opf/layers/x.yml"}]}')"""


@query("base_text_paths", f"""SELECT p_partkey, list_sort(list_filter(coalesce(json_extract_string({_TREE}, '$.tree[*].path'), []), lambda p: contains(p, '.opf/base/') AND ends_with(p, '.txt'))) AS paths FROM part""")
def base_text_paths(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", hits.base_text_paths(F.expr(_TREE)).alias("paths"))


_ARCHIVE = """concat('{"hits":{"hits":[{"_id":"IT1","_score":2.5,"_source":{"inRootInstance":["', CASE p_partkey % 3 WHEN 0 THEN 'bdr:W' WHEN 1 THEN ' http://purl.bdrc.io/resource/W' ELSE '/W' END, p_partkey, '/","bdr:X"],"prefLabel_bo":["', p_name, '"]}},{"_id":"IT2","_routing":"bdr:R', p_partkey, '","_source":{"inRootInstance":["bdr:"]}},{"_id":"', CASE WHEN p_partkey % 2 = 0 THEN 'MW' ELSE 'IT' END, p_partkey, '_O', p_size, '","_source":{}}]}}')"""


@query("archive_hits", """SELECT CASE k WHEN 0 THEN 'W' || p_partkey WHEN 1 THEN 'R' || p_partkey ELSE CASE WHEN p_partkey % 2 = 0 AND p_partkey > 9 THEN 'MW' || p_partkey END END AS id, CASE k WHEN 0 THEN p_name END AS title, (CASE k WHEN 0 THEN 2.5 END)::DOUBLE AS score FROM part, (VALUES (0), (1), (2)) v(k)""")
def archive_hits(spark, sf_dir):
    return hits.archive_hits(_t(spark, sf_dir, "part").select(F.expr(_ARCHIVE).alias("answer")), "answer").select("id", "title", "score")


_RESULTS = """concat('<p class="rlt1">全 1,', lpad(cast(p_size AS varchar(9)), 3, '0'), ' 件中 50件を表示</p><form name="lastpage"><input name="page" value="', p_size, '"></form><table class="result_table"><tr><th>h</th></tr><tr><td><a href="d.php?lineno=J', p_partkey, '">', CASE WHEN p_partkey % 2 = 0 THEN concat(' J', p_partkey, ' ') ELSE '' END, '</a></td><td><a href="i.php?x=1">img</a></td><td>', p_name, '</td><td>A1</td><td>one<lb 01_0001A02_ />', p_brand, '</td></tr><tr><td>short</td></tr></table>')"""


@query("result_page_hits", """SELECT p_partkey, 1000 + p_size AS total, p_size AS pages, 'J' || p_partkey AS lineno, p_name AS title, 'one' || chr(10) || p_brand AS snippet FROM part""")
def result_page_hits(spark, sf_dir):
    p = spread.evenly(_t(spark, sf_dir, "part")).select("p_partkey", hits.result_page(F.expr(_RESULTS)).alias("r"))
    # explode_outer: a filter of the pages with hits would read them once more, before they are dealt
    return p.select("p_partkey", "r.total", "r.pages", F.explode_outer("r.hits").alias("h")).filter("h IS NOT NULL").select("p_partkey", "total", "pages", "h.lineno", "h.title", "h.snippet")
