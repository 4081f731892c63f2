"""Queries that resolve identifiers and titles, over paths and queries made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import paths, rank, spread
from folioscan.plans.queries import _NORM, _PART, _Q, _QW, _inverse, _part, _t, query

_LAST = "ORDER BY prio, ord, path"
_ARGMIN = f"SELECT w.wanted_id, r.path FROM (SELECT DISTINCT wanted_id FROM w) w LEFT JOIN (SELECT wanted_id, path FROM m QUALIFY row_number() OVER (PARTITION BY wanted_id {_LAST}) = 1) r USING (wanted_id)"
_PARTS = "regexp_extract(path, '[^/]*$') AS name, len(string_split(path, '/')) - 1 AS deep"
_STEM = "regexp_replace(name, '(.)[.][^.]*$', '\\1')"


def _files(spark, sf_dir, sql: str):
    return _t(spark, sf_dir, "part").selectExpr(f"{sql} AS path")


def _wanted(spark, sf_dir, sql: str):
    return _t(spark, sf_dir, "customer").selectExpr(f"{sql} AS wanted_id")


def _tables(files: str, wanted: str) -> str:
    return f"WITH f AS (SELECT DISTINCT path, {_PARTS} FROM (SELECT {files} AS path FROM part)), w AS (SELECT DISTINCT {wanted} AS wanted_id FROM customer), s AS (SELECT *, {_STEM} AS stem FROM f)"


# --- identifiers of the canon ------------------------------------------------------------------------------------

_CANON = "CASE p_partkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'X' ELSE 'j' END"
_CANON_FILES = f"concat(CASE WHEN p_partkey % 10 = 7 THEN concat('old/', {_CANON}, 'n', 10000 + p_partkey, 'a') ELSE concat({_CANON}, '/', {_CANON}, p_partkey % 50, '/', {_CANON}, p_partkey % 50, 'n', 10000 + p_partkey) END, '.xml')"
_CANON_IDS = "CASE c_custkey % 5 WHEN 0 THEN concat('T', 10000 + c_custkey) WHEN 1 THEN concat('x', 10000 + c_custkey) WHEN 2 THEN concat('j', 10000 + c_custkey) WHEN 3 THEN concat('X', 100 + c_custkey % 90) ELSE concat('n', 10000 + c_custkey) END"


@query("lookup_cbeta", f"""{_tables(_CANON_FILES, _CANON_IDS)},
i AS (SELECT wanted_id, regexp_extract(wanted_id, '^([A-Za-z]+)[0-9]+$', 1) AS c, regexp_extract(wanted_id, '^[A-Za-z]+([0-9]+)$', 1) AS n FROM w),
m AS (
  SELECT wanted_id, 0 AS prio, 0 AS ord, path FROM i JOIN s ON deep = 2 AND path GLOB (upper(c) || '/' || upper(c) || '*/' || upper(c) || '*n' || n || '.xml')
  UNION ALL SELECT wanted_id, 1, 0, path FROM i JOIN s ON deep = 2 AND path GLOB (lower(c) || '/' || lower(c) || '*/' || lower(c) || '*n' || n || '.xml')
  UNION ALL SELECT wanted_id, 2, 0, path FROM i JOIN s ON starts_with(path, c || '/') AND contains(lower(name), 'n' || n)
  UNION ALL SELECT wanted_id, 3, 0, path FROM i JOIN s ON contains(lower(name), lower(wanted_id))
) {_ARGMIN}""")
def lookup_cbeta(spark, sf_dir):
    return paths.resolve(_files(spark, sf_dir, _CANON_FILES), _wanted(spark, sf_dir, _CANON_IDS), "cbeta")


# --- identifiers of the Pali texts -------------------------------------------------------------------------------

_PALI_FILES = """CASE p_partkey % 13 WHEN 0 THEN concat('sub/x', p_partkey % 7, '_', p_partkey, '.xml') WHEN 1 THEN concat('s010', p_partkey % 4, 'm.toc.xml') ELSE concat('s0', 1 + p_partkey % 5, '0', 1 + p_partkey % 4,
CASE p_partkey % 6 WHEN 0 THEN 'm.mul' WHEN 1 THEN 'a.att' WHEN 2 THEN 't.tik' WHEN 3 THEN concat('m', p_partkey) WHEN 4 THEN 'm.nrf' ELSE concat('A', p_partkey, 'b') END, '.xml') END"""
_PALI_IDS = """CASE c_custkey % 11 WHEN 0 THEN concat('DN', c_custkey % 40) WHEN 1 THEN concat('mn ', c_custkey % 160) WHEN 2 THEN concat('SN', c_custkey % 50, '.', c_custkey % 9) WHEN 3 THEN 'kn' WHEN 4 THEN concat('s010', c_custkey % 6)
WHEN 5 THEN concat('s020', c_custkey % 6, 'a.att') WHEN 6 THEN concat('S0', 1 + c_custkey % 5, '01M') WHEN 7 THEN concat('x', c_custkey % 7, '_', c_custkey % 30) WHEN 8 THEN concat('X', c_custkey % 7, '_1') WHEN 9 THEN concat('s030', c_custkey % 5, 'm') ELSE concat('none', c_custkey) END"""
_U = "(CASE WHEN regexp_matches(upper(wanted_id), '^(DN|MN|SN|AN|KN)\\s*([0-9]+)?([.][0-9]+)?$') THEN upper(wanted_id) END)"


@query("lookup_tipitaka", rf"""{_tables(_PALI_FILES, _PALI_IDS)},
u AS (SELECT wanted_id, substr({_U}, 1, 2) AS k, TRY_CAST(regexp_extract({_U}, '^..\s*([0-9]+)', 1) AS INT) AS n FROM w),
i AS (SELECT wanted_id, n, 's0' || strpos('DMSAK', substr(k, 1, 1)) AS pre, CASE WHEN k = 'DN' AND n > 23 OR k = 'MN' AND n > 100 THEN '03' WHEN k = 'DN' AND n > 13 OR k = 'MN' AND n > 50 THEN '02' ELSE '01' END AS vol FROM u),
m AS (
  SELECT wanted_id, x.prio, 0 AS ord, path FROM i, (VALUES (0, '.xml'), (1, '.mul.xml'), (2, '.att.xml'), (3, '.tik.xml'), (4, '.nrf.xml')) x(prio, suffix), s WHERE path = wanted_id || suffix
  UNION ALL SELECT wanted_id, 5, 0, path FROM i JOIN s ON path = pre || vol || 'm.mul.xml'
  UNION ALL SELECT wanted_id, 6, 0, path FROM i JOIN s ON deep = 0 AND path GLOB (pre || CASE WHEN n IS NULL THEN '' ELSE vol END || '*m.mul.xml')
  UNION ALL SELECT wanted_id, 7, 0, path FROM i JOIN s ON deep = 0 AND path GLOB (pre || '*.xml')
  UNION ALL SELECT wanted_id, 8, (NOT contains(path, '.mul.'))::INT, path FROM i JOIN s ON deep = 0 AND starts_with(path, lower(wanted_id)) AND path NOT LIKE '%toc%'
  UNION ALL SELECT wanted_id, 9, 0, path FROM i JOIN s ON stem = wanted_id
  UNION ALL SELECT wanted_id, 10, TRY_CAST(substr(stem, length(wanted_id) + 1) AS BIGINT), path FROM i JOIN s ON starts_with(stem, wanted_id) AND regexp_full_match(substr(stem, length(wanted_id) + 1), '[0-9]+')
  UNION ALL SELECT wanted_id, 11, coalesce(TRY_CAST(regexp_extract(lower(stem), '([0-9]+)$', 1) AS BIGINT), 4294967295), path FROM i JOIN s ON contains(lower(name), lower(wanted_id)) AND name NOT LIKE '%toc%'
  UNION ALL SELECT wanted_id, 12, 0, path FROM i JOIN s ON contains(lower(stem), lower(wanted_id))
) {_ARGMIN}""")
def lookup_tipitaka(spark, sf_dir):
    return paths.resolve(_files(spark, sf_dir, _PALI_FILES), _wanted(spark, sf_dir, _PALI_IDS), "tipitaka")


# --- identifiers of the Sanskrit texts ---------------------------------------------------------------------------

_SA_FILES = """concat(CASE p_partkey % 11 WHEN 0 THEN 'misc/' WHEN 1 THEN '' ELSE 'sa_' END, replace(p_name, ' ', ''), p_partkey % 40, CASE p_partkey % 3 WHEN 1 THEN '-comm' WHEN 2 THEN '-alt' ELSE '' END, '.xml')"""
_SA_IDS = """CASE c_custkey % 6 WHEN 0 THEN concat('smallring', c_custkey % 40) WHEN 1 THEN concat('sa_redwidget', c_custkey % 40) WHEN 2 THEN concat('ring', c_custkey % 60) WHEN 3 THEN concat('RING', c_custkey % 40, '-C') WHEN 4 THEN concat('Widget', c_custkey % 9) ELSE concat('none', c_custkey) END"""
_SA = "(CASE WHEN starts_with(wanted_id, 'sa_') THEN '' ELSE 'sa_' END || wanted_id)"


@query("lookup_gretil", f"""{_tables(_SA_FILES, _SA_IDS)},
m AS (
  SELECT wanted_id, 0 AS prio, 0 AS ord, path FROM w JOIN s ON path = wanted_id || '.xml'
  UNION ALL SELECT wanted_id, 1, 0, path FROM w JOIN s ON path = {_SA} || '.xml'
  UNION ALL SELECT wanted_id, 2, (contains(name, '-comm') OR contains(name, '-alt'))::INT, path FROM w JOIN s ON deep = 0 AND starts_with(path, {_SA})
  UNION ALL SELECT wanted_id, 3, 0, path FROM w JOIN s ON deep = 0 AND path GLOB ('sa_*' || lower(wanted_id) || '*.xml')
  UNION ALL SELECT wanted_id, 4, 0, path FROM w JOIN s ON stem = wanted_id
  UNION ALL SELECT wanted_id, 5, 0, path FROM w JOIN s ON contains(lower(stem), lower(wanted_id))
) {_ARGMIN}""")
def lookup_gretil(spark, sf_dir):
    return paths.resolve(_files(spark, sf_dir, _SA_FILES), _wanted(spark, sf_dir, _SA_IDS), "gretil")


_SARIT_FILES = "CASE p_partkey % 7 WHEN 0 THEN concat('deep/x/c', p_partkey, '.XML') WHEN 1 THEN concat('deep/d', p_partkey, '.xml') ELSE concat(CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'transliterated/b' END, p_partkey, '.xml') END"
_SARIT_IDS = "CASE c_custkey % 7 WHEN 0 THEN concat('C', c_custkey) WHEN 1 THEN concat('d', c_custkey) WHEN 2 THEN concat('a', c_custkey) WHEN 3 THEN concat('b', c_custkey, '.xml') WHEN 4 THEN concat('transliterated/b', c_custkey) WHEN 5 THEN concat('D', c_custkey % 90) ELSE concat(c_custkey % 90, '') END"


@query("lookup_sarit", f"""{_tables(_SARIT_FILES, _SARIT_IDS)},
x AS (SELECT wanted_id, CASE WHEN contains(wanted_id, '/') THEN NULL WHEN ends_with(wanted_id, '.xml') THEN wanted_id ELSE wanted_id || '.xml' END AS full_name FROM w),
m AS (
  SELECT wanted_id, 0 AS prio, 0 AS ord, path FROM x JOIN s ON path = full_name
  UNION ALL SELECT wanted_id, 1, 0, path FROM x JOIN s ON path = 'transliterated/' || full_name
  UNION ALL SELECT wanted_id, 2, 0, path FROM x JOIN s ON stem = wanted_id
  UNION ALL SELECT wanted_id, 3, 0, path FROM x JOIN s ON contains(lower(stem), lower(wanted_id)) AND ends_with(name, '.xml')
  UNION ALL SELECT wanted_id, 4, 0, path FROM x JOIN s ON lower(name) = lower(wanted_id) || '.xml'
) {_ARGMIN}""")
def lookup_sarit(spark, sf_dir):
    return paths.resolve(_files(spark, sf_dir, _SARIT_FILES), _wanted(spark, sf_dir, _SARIT_IDS), "sarit")


_MUKTA_FILES = "concat(CASE p_partkey % 3 WHEN 0 THEN 'sub/M' ELSE 'm' END, p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.xml' WHEN 1 THEN '.txt' WHEN 2 THEN '.TXT' ELSE '.md' END)"
_MUKTA_IDS = "CASE c_custkey % 4 WHEN 0 THEN concat('m', c_custkey) WHEN 1 THEN concat('M', c_custkey) WHEN 2 THEN concat('m', c_custkey, '.txt') ELSE concat('sub/M', c_custkey) END"


@query("lookup_muktabodha", f"""{_tables(_MUKTA_FILES, _MUKTA_IDS)},
x AS (SELECT wanted_id, CASE WHEN NOT contains(wanted_id, '/') THEN wanted_id END AS plain FROM w),
m AS (
  SELECT wanted_id, prio, 0 AS ord, path FROM x, (VALUES (0, ''), (1, '.xml'), (2, '.txt')) y(prio, suffix), s WHERE path = plain || suffix
  UNION ALL SELECT wanted_id, 3, 0, path FROM x JOIN s ON stem = wanted_id
  UNION ALL SELECT wanted_id, prio, 0, path FROM x, (VALUES (4, '.xml'), (5, '.txt')) y(prio, suffix), s WHERE lower(name) = lower(wanted_id) || suffix
  UNION ALL SELECT wanted_id, 6, 0, path FROM x JOIN s ON lower(stem) = lower(wanted_id) AND (ends_with(name, '.xml') OR ends_with(name, '.txt'))
) {_ARGMIN}""")
def lookup_muktabodha(spark, sf_dir):
    return paths.resolve(_files(spark, sf_dir, _MUKTA_FILES), _wanted(spark, sf_dir, _MUKTA_IDS), "muktabodha")


# --- queries to candidates ---------------------------------------------------------------------------------------

_ASKED = "CASE c_custkey % 8 WHEN 0 THEN concat(' T ', c_custkey) WHEN 1 THEN concat('dn', c_custkey % 40) WHEN 2 THEN concat('s010', c_custkey % 9, 'm. mul') WHEN 3 THEN concat('MN 1.', c_custkey) WHEN 4 THEN 'T99999999999' WHEN 5 THEN c_name WHEN 6 THEN concat('KN x', c_custkey, '.mul') ELSE '' END"
_BLANKLESS = "regexp_replace(q, '\\s', '', 'g')"


@query("resolve_direct", f"""WITH q AS (SELECT c_custkey AS id, {_ASKED} AS q FROM customer), n AS (SELECT id, {_BLANKLESS} AS flat, upper({_BLANKLESS}) AS up FROM q),
d AS (SELECT *, TRY_CAST(regexp_extract(up, '^T([0-9]+)', 1) AS BIGINT) AS t, regexp_extract(up, '^(DN|MN|SN|AN|KN)', 1) AS k, TRY_CAST(regexp_replace(substr(up, 3), '[^0-9]', '', 'g') AS BIGINT) AS v FROM n),
c AS (SELECT id, 'cbeta' AS source, 'T' || repeat('0', greatest(0, 4 - length(t::VARCHAR))::BIGINT) || t AS found, 1.2::DOUBLE AS rank_score FROM d WHERE t < 4294967296
  UNION ALL SELECT id, 'tipitaka', k || v, 1.22::DOUBLE FROM d WHERE k <> '' AND v < 4294967296 UNION ALL SELECT id, 'tipitaka', flat, 1.22::DOUBLE FROM d WHERE contains(flat, '.mul'))
SELECT DISTINCT id, source, found, rank_score FROM c""")
def resolve_direct(spark, sf_dir):
    q = spread.evenly(_t(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_ASKED} AS q"))
    found = rank.given_candidates(q, "q", preferred="tipitaka")
    # explode_outer: a filter of the rows with candidates would compute them once more
    found = found.select(F.col("id").alias("n"), F.explode_outer("candidates").alias("c")).filter("c.by = 'direct-id'")
    return found.select(F.col("n").alias("id"), "c.source", F.col("c.id").alias("found"), "c.rank_score")


_NAMED = "CASE c_custkey % 7 WHEN 0 THEN 'Heart Sutra' WHEN 1 THEN concat('the diamond sutra ', c_custkey) WHEN 2 THEN 't0262' WHEN 3 THEN 'lotus' WHEN 4 THEN 'lankavatara' WHEN 5 THEN concat('T0251 ', c_custkey) ELSE 'vajracchedikA' END"


def _works() -> str:
    """SQL: a row for each name of a work and each of its identifiers."""
    rows = [f"('{T.python_normalised(n)}', '{source}', '{identifier}', '{T.python_normalised(identifier)}')" for names, works in rank.CROSSWALK_WORKS.values() for n in names for source, (identifier, _) in works.items()]
    return f"(VALUES {', '.join(rows)}) a(na, source, found, nf)"


@query("resolve_crosswalk", f"""WITH q AS (SELECT c_custkey AS id, {_NORM.format(f"({_NAMED})")} AS nq FROM customer), a AS (SELECT * FROM {_works()})
SELECT DISTINCT id, source, found, round(1.05 + CASE WHEN source = 'gretil' THEN 0.02 ELSE 0 END + CASE WHEN nq = nf THEN 0.05 ELSE 0 END, 6)::DOUBLE AS rank_score FROM q JOIN a ON nq = na OR (strlen(nq) >= 6 AND (contains(na, nq) OR contains(nq, na)))
WHERE NOT (source = 'cbeta' AND nq = nf)""")
def resolve_crosswalk(spark, sf_dir):
    """A work that the query names by its own identifier is a direct candidate already."""
    q = spread.evenly(_t(spark, sf_dir, "customer").selectExpr("c_custkey AS n", f"{_NAMED} AS q"))
    found = rank.given_candidates(q, "q", preferred="gretil", limit=100).select("n", F.explode_outer("candidates").alias("c")).filter("c.by = 'crosswalk'")
    return found.select(F.col("n").alias("id"), "c.source", F.col("c.id").alias("found"), "c.rank_score")


# --- titles of a corpus ------------------------------------------------------------------------------------------

_J0 = "greatest(cj, tj)"
_HELD = f"(CASE WHEN contains(nm, '{_Q}') THEN 1.0 WHEN {_J0} < 0.95 AND (ordered OR {_inverse('nm')}) THEN greatest({_J0}, 0.85) ELSE {_J0} END)"
_ALIAS = "CASE WHEN id % 5 = 0 THEN 'old green widget 12 text' WHEN id % 5 = 1 THEN '' END"


_MARKED_TITLE = "translate(p_name, 'aiu', 'āīū')"
_MARKED_PART = _PART.replace("FROM part)", f"FROM (SELECT * REPLACE ({_MARKED_TITLE} AS p_name) FROM part))")


@query("title_search_pali", f"""WITH {_MARKED_PART}, a AS (SELECT id, p_name, ws, {_HELD} AS s, {_ALIAS} AS alias FROM j),
b AS (SELECT id, p_name, ws, CASE WHEN contains(coalesce(alias, ''), '{_QW}') THEN greatest(s, 0.95) ELSE s END AS s FROM a)
SELECT id, p_name, round(CASE WHEN contains(ws, '{_QW}') THEN least(s + 0.05, 1.0) ELSE s END, 6) AS score FROM b ORDER BY score DESC, id LIMIT 10""")
def title_search_pali(spark, sf_dir):
    """Titles by their folded forms as well, with an alias that may hold the query."""
    entries = rank.with_hay(_part(spark, sf_dir).withColumns({"p_name": F.expr(_MARKED_TITLE), "alias": F.expr(_ALIAS)}), F.col("p_name"), folded=True)
    return rank.title_search(entries, _QW, alias="alias", folded=True).select("id", "p_name", "score")


@query("title_search_canon", f"""WITH {_PART}, a AS (SELECT 'X' || id AS id, CASE WHEN contains(ws, '{_QW}') THEN least({_HELD} + 0.05, 1.0) ELSE {_HELD} END AS s, CASE WHEN id % 3 = 0 THEN 'T' ELSE 'X' END AS canon, {_NORM.format("p_brand")} AS nb FROM j),
b AS (SELECT id, nb, CASE WHEN canon = 'T' THEN least(s + 0.02, 1.2) ELSE s END AS s FROM a)
SELECT id, round(CASE WHEN nb <> '' AND (contains(nb, '{_Q}') OR contains('{_Q}', nb)) THEN greatest(s, 0.93) ELSE s END, 6) AS score FROM b ORDER BY score DESC, id LIMIT 10""")
def title_search_canon(spark, sf_dir):
    """Titles with a preferred canon and contributors."""
    entries = rank.with_hay(_part(spark, sf_dir), F.col("p_name")).withColumns({"id": F.expr("concat('X', id)"), "canon": F.expr("CASE WHEN id % 3 = 0 THEN 'T' ELSE 'X' END")})
    return rank.title_search(entries, _QW, contributors=("p_brand",), canon="canon").select("id", "score")


# --- many titles at once -----------------------------------------------------------------------------------------

_CALLED = "concat(CASE c_custkey % 4 WHEN 0 THEN 'the ' WHEN 1 THEN '' WHEN 2 THEN 'big ' ELSE 'new ' END, CASE c_custkey % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'lightgreen' ELSE 'redd' END, ' ', c_name, ' widgets')"
_BIGRAMS = "list_distinct(list_transform(range(0, (strlen({0}) - 1)::BIGINT), lambda i: substr(hex({0}), (2 * i + 1)::BIGINT, 4)))"


@query("resolve_batch", f"""WITH q AS (SELECT c_custkey AS query_id, {_NORM.format(_CALLED.replace("c_name", "'#'"))} AS q FROM customer),
t AS (SELECT p_partkey AS id, {_NORM.format("p_name")} AS t FROM part),
qs AS (SELECT q, unnest({_BIGRAMS.format("q")}) AS g FROM (SELECT DISTINCT q FROM q)), ts AS (SELECT t, unnest({_BIGRAMS.format("t")}) AS g FROM (SELECT DISTINCT t FROM t)),
nq AS (SELECT q, count(*) AS n FROM qs GROUP BY q), nt AS (SELECT t, count(*) AS n FROM ts GROUP BY t),
i AS (SELECT q, t, count(*) AS i FROM qs JOIN ts USING (g) GROUP BY q, t),
s AS (SELECT q, t, i::DOUBLE / (nq.n + nt.n - i) AS score FROM i JOIN nq USING (q) JOIN nt USING (t))
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)::INT AS place FROM q JOIN s USING (q) JOIN t USING (t) WHERE score >= 0.5
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) <= 5""")
def resolve_batch(spark, sf_dir):
    """A title wanted by each customer among all parts."""
    q = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS query_id", f"{_CALLED.replace('c_name', repr('#'))} AS text")
    return rank.resolve_batch(q, _t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS title"), 0.5, 5)


@query("crosswalk_names", f"""WITH n AS (SELECT DISTINCT p_partkey % 400 AS key, {_NORM.format("substr(p_name, 1, 3 + p_partkey % 9)")} AS na FROM part), q AS (SELECT c_custkey, {_NORM.format(_CALLED)} AS nq FROM customer)
SELECT DISTINCT c_custkey, key FROM q JOIN n ON na <> '' AND (na = nq OR (strlen(nq) >= 6 AND (contains(na, nq) OR contains(nq, na))))""")
def crosswalk_names(spark, sf_dir):
    """Names of any number, held against what each customer asks for in both directions."""
    q = spread.evenly(_t(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_CALLED} AS called")).select(F.col("c_custkey").alias("id"), T.normalised(F.col("called")).alias("nq"))
    called = spread.evenly(_t(spark, sf_dir, "part").selectExpr("p_partkey % 400 AS key", "substr(p_name, 1, cast(3 + p_partkey % 9 AS int)) AS called").distinct())
    names = called.select("key", T.normalised(F.col("called")).alias("na"))
    return rank.crosswalk_distinct(q, names).select(F.col("id").alias("c_custkey"), "key")
