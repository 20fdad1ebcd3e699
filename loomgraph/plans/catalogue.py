"""One query per operator over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import imports as I
from loomgraph.functions import paths as P
from loomgraph.functions import text as T
from loomgraph.operators import blocks, caching, identifiers, imports, keywords, lookup, neighborhood, packages, styling, views
from loomgraph.operators import paths as paths_of
from loomgraph.operators._store import cut, new_path
from loomgraph.plans import adapters as A
from loomgraph.sources import links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

START, LIB, SEARCH = "d:ASIA", "l:Brand#13", ("n_1", "c19", "customer#000000007", "asia")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- SQL that several oracles share ----------------------------------------------------------------------------------

_LIST = "list AS (SELECT doc_id, n_chars * 100 AS size, source || '/' || [" + ", ".join(f"'{x}'" for x in A.FOLDERS) + f"][CAST(doc_id % {len(A.FOLDERS)} AS INTEGER) + 1] || '/f' || CAST(doc_id AS VARCHAR) || [" + ", ".join(f"'{x}'" for x in A.ENDINGS) + f"][CAST(doc_id % {len(A.ENDINGS)} AS INTEGER) + 1] AS path FROM documents)"
_NODES = """nodes AS (
 SELECT 'dir' AS kind, 'd:' AS key, 'r' AS name, '' AS path, CAST(NULL AS VARCHAR) AS parent_key, CAST(NULL AS VARCHAR) AS file_key
 UNION ALL SELECT 'dir', 'd:' || r_name, r_name, r_name, 'd:', NULL FROM region
 UNION ALL SELECT 'dir', 'd:' || r_name || '/' || n_name, n_name, r_name || '/' || n_name, 'd:' || r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'file', 'f:' || c_name, c_name, r_name || '/' || n_name || '/' || c_name, 'd:' || r_name || '/' || n_name, 'f:' || c_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'class' WHEN '2' THEN 'type' WHEN '3' THEN 'function' WHEN '4' THEN 'method' WHEN '5' THEN 'variable' END,
  's:' || CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), r_name || '/' || n_name || '/' || c_name, 'f:' || c_name, 'f:' || c_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT DISTINCT 'lib', 'l:' || p_brand, p_brand, '', NULL, NULL FROM part)"""
_EDGES = _NODES + """, edges AS (
 SELECT s, t, max(type) AS type FROM (
  SELECT parent_key AS s, key AS t, 2 AS type FROM nodes WHERE parent_key IS NOT NULL
  UNION ALL SELECT 's:' || CAST(l_orderkey AS VARCHAR), 'l:' || p_brand, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 3 END
   FROM lineitem JOIN part ON l_partkey = p_partkey WHERE 's:' || CAST(l_orderkey AS VARCHAR) IN (SELECT key FROM nodes)) x GROUP BY s, t)"""
_CODE = _EDGES + """, shown AS (SELECT * FROM nodes WHERE kind NOT IN ('dir', 'keyword')),
 ve AS (SELECT s, t, max(type) AS type FROM edges WHERE s <> t AND s IN (SELECT key FROM shown) AND t IN (SELECT key FROM shown) GROUP BY s, t)"""
_FILES = _EDGES + """, shown AS (SELECT * FROM nodes WHERE kind IN ('dir', 'file', 'lib')),
 lifted AS (SELECT CASE WHEN type = 2 OR a.kind IN ('dir', 'file', 'lib') THEN s ELSE a.file_key END AS s, CASE WHEN type = 2 OR b.kind IN ('dir', 'file', 'lib') THEN t ELSE b.file_key END AS t, type
  FROM edges JOIN nodes a ON s = a.key JOIN nodes b ON t = b.key),
 ve AS (SELECT s, t, max(type) AS type FROM lifted WHERE s <> t AND s IN (SELECT key FROM shown) AND t IN (SELECT key FROM shown) GROUP BY s, t)"""
_ADJ = ", adj AS (SELECT s AS u, t AS w FROM ve UNION ALL SELECT t, s FROM ve)"
_DEG = _ADJ + ", deg AS (SELECT key, count(u) AS deg FROM shown LEFT JOIN adj ON key = u GROUP BY key)"


def _bfs(depth: int) -> str:
    return _FILES + _DEG + f""", walk AS (SELECT '{START}' AS key, 0 AS depth UNION SELECT w, depth + 1 FROM walk JOIN adj ON u = key WHERE depth < {depth}),
 nb AS (SELECT key, min(depth) AS depth FROM walk GROUP BY key)"""


_NBE = ", nbe AS (SELECT * FROM ve WHERE s IN (SELECT key FROM nb) AND t IN (SELECT key FROM nb))"


def _with(body: str) -> str:
    return "WITH RECURSIVE " + body + " "


def _graph(spark, sf_dir):
    """Nodes and edges, each written once."""
    nodes, edges = _graph_once(spark, sf_dir)
    return nodes, cut(edges)


def _graph_once(spark, sf_dir):
    """Nodes, written once, and edges for a single use."""
    nodes = cut(A.star_nodes(spark, sf_dir))
    return nodes, A.star_edges(spark, sf_dir, nodes)


def _files_view(spark, sf_dir):
    nodes, edges = _graph_once(spark, sf_dir)
    return views.view_nodes(nodes, "files"), views.view_edges(nodes, edges, "files")


# ---- the graph and its views -----------------------------------------------------------------------------------------


@query(_with(_FILES + _DEG) + "SELECT key, deg FROM deg")
def degree(spark, sf_dir):
    return views.degree(*_files_view(spark, sf_dir))


@query(_with(_NODES) + "SELECT kind, key, name, path, parent_key, file_key FROM nodes")
def graph_nodes(spark, sf_dir):
    return A.star_nodes(spark, sf_dir)


@query(_with(_EDGES) + "SELECT s, t, type FROM edges")
def graph_edges(spark, sf_dir):
    return A.star_edges(spark, sf_dir)


@query(_with(_NODES) + "SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind NOT IN ('dir', 'file', 'lib', 'keyword')) AS symbols, count(*) FILTER (kind = 'lib') AS libs, count(*) FILTER (kind = 'keyword') AS keywords FROM nodes")
def graph_stats(spark, sf_dir):
    return views.stats(A.star_nodes(spark, sf_dir))


@query(_with(_CODE) + "SELECT s, t, type FROM ve")
def view_code(spark, sf_dir):
    return views.view_edges(*_graph_once(spark, sf_dir), "code")


@query(_with(_FILES) + "SELECT s, t, type FROM ve")
def view_files(spark, sf_dir):
    return _files_view(spark, sf_dir)[1]


@query(_with(_CODE) + "SELECT s, t, type FROM ve WHERE type <> 1 AND s NOT IN (SELECT key FROM nodes WHERE kind = 'variable') AND t NOT IN (SELECT key FROM nodes WHERE kind = 'variable')")
def view_filtered(spark, sf_dir):
    return views.view_edges(*_graph_once(spark, sf_dir), "code", ("vars", "refs"))


@query(_with(_NODES) + "SELECT key FROM nodes WHERE kind = 'lib'")
def view_fallback(spark, sf_dir):
    """Of libraries alone, hidden: nothing would be left, so all are shown."""
    return views.view_nodes(A.star_nodes(spark, sf_dir).where("kind = 'lib'"), "code", ("libs",)).select("key")


@query(_with(_CODE + _DEG) + "SELECT key, CAST(deg AS DOUBLE) AS score FROM deg JOIN nodes USING (key) WHERE kind = 'file' ORDER BY deg DESC, key LIMIT 1")
def default_node_code(spark, sf_dir):
    nodes, edges = _graph_once(spark, sf_dir)
    shown = views.view_nodes(nodes, "code")
    return views.default_node(nodes, views.degree(shown, views.view_edges(nodes, edges, "code")), "code")


@query(_with(_EDGES) + f"SELECT s AS key, CASE type WHEN 1 THEN 'ref' WHEN 2 THEN 'contain' ELSE 'dep' END AS type FROM edges WHERE t = '{LIB}'")
def edges_in(spark, sf_dir):
    return views.edges_of(A.star_edges(spark, sf_dir), LIB, "in")


@query(_with(_EDGES) + f"SELECT t AS key, CASE type WHEN 1 THEN 'ref' WHEN 2 THEN 'contain' ELSE 'dep' END AS type FROM edges WHERE s = '{START}'")
def edges_out(spark, sf_dir):
    return views.edges_of(A.star_edges(spark, sf_dir), START, "out")


@query(_with(_NODES) + "SELECT key, CASE WHEN kind = 'variable' THEN 'vars' WHEN kind = 'lib' THEN 'libs' END AS hidden FROM nodes")
def hidden_by(spark, sf_dir):
    return A.star_nodes(spark, sf_dir).select("key", views.hidden_by().alias("hidden"))


@query("WITH " + _LIST + f""" SELECT doc_id, CASE WHEN doc_id % 3 <> 1 AND regexp_matches(path || CASE WHEN doc_id % 3 = 2 THEN '/' ELSE '' END, '(?i){P.TEST_PATTERN}') THEN 'tests' WHEN doc_id % 3 = 1 THEN 'libs' END AS hidden FROM list""")
def hidden_by_path(spark, sf_dir):
    """F8 over files, libraries and folders with the names of tests among them."""
    kind = F.element_at(F.array(*map(F.lit, ["file", "lib", "dir"])), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return A.listing(spark, sf_dir).withColumn("kind", kind).select("doc_id", views.hidden_by().alias("hidden"))


# ---- neighbourhoods --------------------------------------------------------------------------------------------------


def _checked(spark, sf_dir):
    shown, edges = _files_view(spark, sf_dir)
    return shown, cut(edges)


@query(_with(_bfs(3)) + "SELECT key, depth FROM nb")
def bfs_depth(spark, sf_dir):
    return neighborhood.bfs(_files_view(spark, sf_dir)[1], START, 3).select("key", "depth")


@query(_with(_bfs(3)) + f"SELECT a.key AS key, a.depth AS depth, min(b.key) AS \"from\" FROM nb a LEFT JOIN adj ON adj.w = a.key LEFT JOIN nb b ON b.key = adj.u AND b.depth = a.depth - 1 GROUP BY a.key, a.depth")
def bfs_parent(spark, sf_dir):
    return neighborhood.bfs(_files_view(spark, sf_dir)[1], START, 3)


@query(_with(_bfs(3) + _NBE) + "SELECT (SELECT count(*) FROM nb) AS nodes, (SELECT count(*) FROM nbe) AS edges")
def bfs_totals(spark, sf_dir):
    edges = _checked(spark, sf_dir)[1]
    return neighborhood.totals(edges, neighborhood.bfs(edges, START, 3))


@query(_with(_bfs(2) + _NBE) + "SELECT s, t, type FROM nbe")
def bfs_edges(spark, sf_dir):
    edges = _checked(spark, sf_dir)[1]
    return neighborhood.induced(edges, neighborhood.bfs(edges, START, 2))


_BUDGET = _with(_bfs(3)) + f""", l1 AS (SELECT key, row_number() OVER (ORDER BY score DESC, deg DESC, key) AS rn FROM (SELECT nb.key, count(*) AS score, any_value(deg) AS deg FROM nb JOIN adj ON adj.w = nb.key JOIN deg ON deg.key = nb.key WHERE depth = 1 AND u = '{START}' GROUP BY nb.key) x),
 k1 AS (SELECT key FROM l1 WHERE rn <= greatest(1, floor((50 - 1) * 0.7))),
 l2 AS (SELECT key, row_number() OVER (ORDER BY score DESC, deg DESC, key) AS rn FROM (SELECT nb.key, count(*) AS score, any_value(deg) AS deg FROM nb JOIN adj ON adj.w = nb.key JOIN deg ON deg.key = nb.key WHERE depth = 2 AND u IN (SELECT key FROM k1) GROUP BY nb.key) x),
 k2 AS (SELECT key FROM l2 WHERE rn <= greatest(1, floor((50 - 1 - (SELECT count(*) FROM k1)) * 0.7))),
 l3 AS (SELECT key, row_number() OVER (ORDER BY score DESC, deg DESC, key) AS rn FROM (SELECT nb.key, count(*) AS score, any_value(deg) AS deg FROM nb JOIN adj ON adj.w = nb.key JOIN deg ON deg.key = nb.key WHERE depth = 3 AND u IN (SELECT key FROM k2) GROUP BY nb.key) x),
 k3 AS (SELECT key FROM l3 WHERE rn <= 50 - 1 - (SELECT count(*) FROM k1) - (SELECT count(*) FROM k2)),
 kept AS (SELECT '{START}' AS key, 0 AS depth UNION ALL SELECT key, 1 FROM k1 UNION ALL SELECT key, 2 FROM k2 UNION ALL SELECT key, 3 FROM k3) """


def _budgeted(spark, sf_dir):
    """The edges are written once, from either end."""
    shown, edges = _files_view(spark, sf_dir)
    ends = neighborhood.around(edges)
    return neighborhood.budgeted(edges, views.degree_of(shown, ends), START, 3, 50, ends)


@query(_BUDGET + 'SELECT a.key AS key, a.depth AS depth, min(b.key) AS "from" FROM kept a LEFT JOIN adj ON adj.w = a.key LEFT JOIN kept b ON b.key = adj.u AND b.depth = a.depth - 1 GROUP BY a.key, a.depth')
def bfs_budget_parent(spark, sf_dir):
    """G4 with a node budget."""
    return _budgeted(spark, sf_dir)


@query(_BUDGET + "SELECT key, depth FROM kept")
def bfs_budget(spark, sf_dir):
    return _budgeted(spark, sf_dir).drop("from")


@query(_with(_NODES + """, up AS (SELECT key, parent_key AS ancestor, 1 AS hops FROM nodes WHERE parent_key IS NOT NULL
 UNION ALL SELECT up.key, n.parent_key, hops + 1 FROM up JOIN nodes n ON n.key = up.ancestor WHERE n.parent_key IS NOT NULL)""") + "SELECT key, ancestor, hops FROM up")
def ancestors(spark, sf_dir):
    return neighborhood.ancestors(A.star_nodes(spark, sf_dir))


# ---- lookup ----------------------------------------------------------------------------------------------------------


def _search_sql(q: str) -> str:
    chain = ".*".join(q.replace("#", "\\#"))
    return f"""(SELECT '{q}' AS query, key, cls, row_number() OVER (ORDER BY cls, n, key) AS rank FROM (SELECT key, length(name) AS n,
 CASE WHEN lower(name) = '{q}' THEN 0 WHEN starts_with(lower(name), '{q}') THEN 1 WHEN contains(lower(name), '{q}') THEN 2 WHEN kind = 'file' AND contains(lower(path), '{q}') THEN 3
 WHEN regexp_matches(lower(name), '{chain}') THEN 4 END AS cls FROM nodes) x WHERE cls IS NOT NULL QUALIFY rank <= 50)"""


@query(_with(_NODES) + " UNION ALL ".join(map(_search_sql, SEARCH)))
def search_rank(spark, sf_dir):
    nodes = cut(A.star_nodes(spark, sf_dir))
    out = None
    for q in SEARCH:
        hits = lookup.search(nodes, q).select(F.lit(q).alias("query"), "key", "cls", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


@query(_with(_EDGES) + f"""SELECT section, key, weak, rn, total FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY first, name, key) AS rn, count(*) OVER (PARTITION BY section) AS total FROM (
 SELECT 'used_by' AS section, s AS key, type = 1 AS weak, CASE type WHEN 1 THEN 1 ELSE 0 END AS first, name FROM edges JOIN nodes ON key = s WHERE t = '{LIB}' AND type <> 2) x) y WHERE rn <= 150""")
def details_lists(spark, sf_dir):
    return lookup.details(*_graph_once(spark, sf_dir), LIB)


@query(_with(_EDGES) + f"""SELECT 'children' AS section, key, FALSE AS weak, row_number() OVER (ORDER BY CASE kind WHEN 'dir' THEN 0 ELSE 1 END, name, key) AS rn, count(*) OVER () AS total FROM edges JOIN nodes ON key = t WHERE s = '{START}'""")
def details_children(spark, sf_dir):
    return lookup.details(*_graph_once(spark, sf_dir), START)


@query(_with(_EDGES) + """SELECT key, count(e.s) AS n FROM nodes LEFT JOIN edges e ON CASE WHEN kind IN ('lib', 'keyword') THEN e.t = key ELSE e.s = key AND (kind = 'dir' OR type = 2) END WHERE kind IN ('lib', 'keyword', 'dir', 'file') AND kind IN ('lib', 'dir') GROUP BY key
 UNION ALL SELECT key, count(e.s) AS n FROM nodes LEFT JOIN edges e ON e.s = key AND e.type = 2 WHERE kind = 'file' GROUP BY key""")
def peek_counts(spark, sf_dir):
    return lookup.peek_counts(*_graph(spark, sf_dir))


@query(_with(_NODES) + "SELECT key, CASE WHEN kind IN ('dir', 'file', 'lib') THEN key ELSE file_key END AS view_key FROM nodes")
def map_into(spark, sf_dir):
    nodes = A.star_nodes(spark, sf_dir)
    return lookup.map_into(nodes, views.view_nodes(nodes, "files"))


@query(_with(_NODES) + """SELECT key, CASE WHEN kind = 'dir' THEN 'files' ELSE 'code' END AS view, CASE kind WHEN 'variable' THEN 'vars' WHEN 'lib' THEN 'libs' END AS toggle, key AS view_key FROM nodes""")
def reveal_from_code(spark, sf_dir):
    """What to do to see each node from the code view without variables and libraries."""
    return views.reveal(A.star_nodes(spark, sf_dir), "code", ("vars", "libs"))


@query(_with(_NODES) + """SELECT key, CASE WHEN kind IN ('dir', 'file') THEN 'files' ELSE 'code' END AS view, CASE WHEN kind = 'lib' THEN 'libs' END AS toggle, key AS view_key FROM nodes""")
def reveal_from_files(spark, sf_dir):
    """G9 from the files view without libraries: symbols are in the code view."""
    return views.reveal(A.star_nodes(spark, sf_dir), "files", ("libs",))


@query("""SELECT point_id, span_id FROM (SELECT p.event_id AS point_id, s.event_id AS span_id, row_number() OVER (PARTITION BY p.event_id ORDER BY floor(s.value), epoch_us(s.ts) // 1000000 DESC, s.event_id) AS rn
 FROM events p JOIN events s ON p.user_id = s.user_id AND p.event_id <> s.event_id AND epoch_us(p.ts) // 1000000 BETWEEN epoch_us(s.ts) // 1000000 AND epoch_us(s.ts) // 1000000 + CAST(floor(s.value) AS BIGINT) * 60) x WHERE rn = 1""")
def innermost(spark, sf_dir):
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    events = A.read(spark, sf_dir, "events")
    spans = events.select(F.col("user_id").alias("grp"), F.col("event_id").alias("span_id"), at.alias("lo"), (at + F.floor("value") * 60).alias("hi"))
    points = events.select(F.col("user_id").alias("grp"), F.col("event_id").alias("point_id"), at.alias("at"))
    return lookup.innermost(spans, points, 3600.0)


# ---- keywords and texts ----------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in T.STOP)
_TERMS = f"""files AS (SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, coalesce(text, '') AS text FROM documents),
 ids AS (SELECT doc_id, ident, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) AS ident FROM files) x WHERE length(ident) >= 2 GROUP BY doc_id, ident),
 words AS (SELECT doc_id, n, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(ident, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+'))) AS w FROM ids),
 stems AS (SELECT doc_id, n, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|os)$') THEN left(w, length(w) - 1) ELSE w END AS word FROM words),
 terms AS (SELECT doc_id, word, CAST(sum(n) AS BIGINT) AS c FROM stems WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY doc_id, word),
 dfs AS (SELECT word, count(*) AS df FROM terms GROUP BY word), total AS (SELECT count(*) AS n FROM documents),
 vocab AS (SELECT word, df FROM dfs, total WHERE total.n >= 3 AND df >= CASE WHEN total.n > 60 THEN 3 ELSE 2 END AND df <= greatest(3, floor(total.n * 0.4))
  QUALIFY row_number() OVER (ORDER BY round(df * ln(CAST(total.n AS DOUBLE) / df), 9) DESC, word) <= greatest(30, least(500, floor(total.n / 3.0 + 0.5)))),
 tops AS (SELECT doc_id, word, c, row_number() OVER (PARTITION BY doc_id ORDER BY round(c * ln(CAST(total.n AS DOUBLE) / df), 9) DESC, word) AS rn FROM terms JOIN vocab USING (word), total QUALIFY rn <= 8)"""


def _files(spark, sf_dir):
    """Files, their number, and whether each doc_id is one file's."""
    return A.doc_files(spark, sf_dir), *keywords.sizes(A.read(spark, sf_dir, "documents"))


def _tops(spark, sf_dir):
    files, n, single = _files(spark, sf_dir)
    return files, keywords.top_words(files, n, single)


@query("WITH " + _TERMS + " SELECT doc_id, word, c FROM terms")
def term_freq(spark, sf_dir):
    files, _, single = _files(spark, sf_dir)
    return keywords.term_counts(files, single)


@query("WITH " + _TERMS + " SELECT word, df FROM dfs")
def doc_freq(spark, sf_dir):
    files, _, single = _files(spark, sf_dir)
    return keywords.document_counts(files, single)


@query("WITH " + _TERMS + " SELECT word, df FROM vocab")
def keyword_vocab(spark, sf_dir):
    files, n, single = _files(spark, sf_dir)
    return keywords.vocabulary(keywords.document_counts(files, single), n)


@query("WITH " + _TERMS + " SELECT doc_id, word, c, rn FROM tops")
def keyword_top8(spark, sf_dir):
    return _tops(spark, sf_dir)[1]


@query("WITH " + _TERMS + " SELECT doc_id AS file, 'k:' || word AS word FROM tops")
def view_words(spark, sf_dir):
    return _tops(spark, sf_dir)[1].select(F.col("doc_id").alias("file"), F.concat(F.lit("k:"), "word").alias("word"))


@query("WITH " + _TERMS + " SELECT 'k:' || word AS key, CAST(count(*) AS DOUBLE) AS score FROM tops GROUP BY word ORDER BY score DESC, key LIMIT 1")
def default_node_words(spark, sf_dir):
    words = view_words(spark, sf_dir)
    degrees = words.groupBy(F.col("word").alias("key")).agg(F.count("*").alias("deg"))
    nodes = degrees.select("key", F.lit("keyword").alias("kind"), F.lit("").alias("path"), F.lit("").alias("name"))
    return views.default_node(nodes, degrees, "words")


@query("WITH " + _TERMS + """ SELECT word, doc_id, line, substr(regexp_replace(snippet, '^\\s+|\\s+$', '', 'g'), 1, 140) AS snippet FROM (
 SELECT word, doc_id, line, regexp_replace(coalesce(string_split(text, chr(10))[line + 1], ''), '\\r$', '') AS snippet FROM (
 SELECT word, doc_id, text, length(pre) - length(replace(pre, chr(10), '')) AS line FROM (
 SELECT word, doc_id, text, substr(text, 1, instr(lower(text), word) - 1) AS pre FROM tops w JOIN files USING (doc_id) WHERE instr(lower(text), word) > 0) a) b) c""")
def keyword_mentions(spark, sf_dir):
    return keywords.all_mentions(*_files(spark, sf_dir))


@query("SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines FROM documents")
def line_count(spark, sf_dir):
    return A.doc_files(spark, sf_dir).select("doc_id", T.count_lines(F.col("text")).alias("lines"))


@query("SELECT doc_id, regexp_replace(coalesce(string_split(coalesce(text, ''), chr(10))[3], ''), '\\r$', '') AS line FROM documents")
def line_lookup(spark, sf_dir):
    return A.doc_files(spark, sf_dir).select("doc_id", T.line_at(F.col("text"), 2).alias("line"))


@query("SELECT doc_id, instr(substr(coalesce(text, ''), 1, 4000), chr(0)) > 0 AS is_binary FROM documents")
def binary_sniff(spark, sf_dir):
    return A.doc_files(spark, sf_dir).select("doc_id", T.is_binary(F.col("text")).alias("is_binary"))


@query("SELECT doc_id, sha1(encode('blob ' || CAST(octet_length(encode(coalesce(text, ''))) AS VARCHAR)) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS sha FROM documents")
def git_sha(spark, sf_dir):
    return A.doc_files(spark, sf_dir).select("doc_id", T.git_sha(F.col("text")).alias("sha"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=[\"'']([^\"'']+)[\"'']', 1)) AS href FROM pages")
def href_links(spark, sf_dir):
    """Every anchor's target, repeats included."""
    found = F.regexp_extract_all("html", F.lit("<a\\s[^>]*?href=[\"']([^\"']+)[\"']"), 1)
    return A.read(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("href"))


# ---- paths and links -------------------------------------------------------------------------------------------------

_LANGS = "langs(ext, grp) AS (VALUES " + ", ".join(f"('{e}', '{g}')" for g, es in P.EXTENSIONS.items() for e in es.split()) + "), names(name, grp) AS (VALUES " + ", ".join(f"('{n}', '{g}')" for g, ns in P.NAMES.items() for n in ns.split()) + ")"
_OF = f"""{_LIST}, {_LANGS}, based AS (SELECT *, lower(string_split(path, '/')[-1]) AS base FROM list),
 named AS (SELECT b.*, coalesce(n.grp, l.grp) AS grp FROM based b LEFT JOIN names n ON n.name = base LEFT JOIN langs l ON l.ext = nullif(regexp_extract(base, '^.+\\.([^.]*)$', 1), ''))"""


@query("WITH " + _OF + " SELECT doc_id, path, grp FROM named")
def language_of(spark, sf_dir):
    return A.listing(spark, sf_dir).select("doc_id", "path", P.language_of(F.col("path")).alias("grp"))


@query("WITH " + _OF + f""" SELECT doc_id, grp IS NOT NULL AND NOT list_has_any(string_split(path, '/')[:-2], [{", ".join(f"'{x}'" for x in P.SKIP_DIRS)}])
 AND len(list_filter(string_split(path, '/')[:-2], lambda x: starts_with(x, '.') AND x <> '.github')) = 0
 AND base NOT IN ({", ".join(f"'{x}'" for x in P.SKIP_FILES)}) AND NOT regexp_matches(base, '{P.SKIP_PATTERN}')
 AND size <= CASE WHEN grp IN ('text', 'md', 'html', 'css') THEN 250000 ELSE 800000 END AS wanted, regexp_matches(path, '(?i){P.TEST_PATTERN}') AS is_test FROM named""")
def wanted_files(spark, sf_dir):
    path = F.col("path")
    return A.listing(spark, sf_dir).select("doc_id", P.wanted(path, F.col("size")).alias("wanted"), P.is_test(path).alias("is_test"))


_DOCLINKS = ["https://github.com/{s}/r.git", "{s}/r{d}", "https://www.github.com/{s}/r/tree/v{d}/src/a b", "http://github.com/{s}/r/blob/main/x/f{d}.js", "github.com/{s}/r/commit/c{d}", "https://github.com/{s}/r/releases/tag/v{d}%2B1/", "no link at all"]


@query("WITH made AS (SELECT doc_id, replace(replace([" + ", ".join(f"'{x}'" for x in _DOCLINKS) + f"""][CAST(doc_id % {len(_DOCLINKS)} AS INTEGER) + 1], '{{s}}', source), '{{d}}', CAST(doc_id AS VARCHAR)) AS link, doc_id % {len(_DOCLINKS)} AS k FROM documents)
 SELECT doc_id, CASE WHEN k = 6 THEN NULL ELSE source END AS owner, CASE k WHEN 6 THEN NULL WHEN 1 THEN 'r' || d ELSE 'r' END AS repo,
 CASE k WHEN 6 THEN NULL WHEN 2 THEN 'v' || d WHEN 3 THEN 'main' WHEN 4 THEN 'c' || d WHEN 5 THEN 'v' || d || '+1' ELSE '' END AS ref, CASE k WHEN 6 THEN NULL WHEN 2 THEN 'src/a' ELSE '' END AS sub,
 CASE k WHEN 6 THEN NULL WHEN 3 THEN 'x/f' || d || '.js' ELSE '' END AS focus FROM (SELECT *, CAST(doc_id AS VARCHAR) AS d FROM made JOIN documents USING (doc_id)) x""")
def parse_link(spark, sf_dir):
    made = F.element_at(F.array(*map(F.lit, _DOCLINKS)), (F.pmod("doc_id", F.lit(len(_DOCLINKS))) + 1).cast("int"))
    made = F.replace(F.replace(made, F.lit("{s}"), F.col("source")), F.lit("{d}"), F.col("doc_id").cast("string"))
    return A.read(spark, sf_dir, "documents").select("doc_id", links.parse_link(made).alias("spec")).select("doc_id", *(F.col(f"spec.{c}").alias(c) for c in links.SPEC))


@query("""WITH parts AS (SELECT doc_id, ['v1', source, lang, 'f' || CAST(doc_id AS VARCHAR)] AS p FROM documents)
 SELECT doc_id, k, array_to_string(p[1:k], '/') AS ref, array_to_string(p[k + 1:], '/') AS sub, '' AS focus FROM parts, (SELECT unnest([1, 2, 3, 4]) AS k) x""")
def link_splits(spark, sf_dir):
    specs = A.read(spark, sf_dir, "documents").select("doc_id", F.lit("v1").alias("ref"), F.concat_ws("/", "source", "lang", F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("sub"), F.lit("").alias("focus"))
    return links.splits(specs).select("doc_id", "k", "ref", "sub", "focus")


@query(_with(_NODES) + "SELECT key, CASE WHEN kind <> 'dir' AND path <> '' THEN 'https://github.com/o/r/blob/main/' || replace(replace(path, '#', '%23'), ' ', '%20') || CASE kind WHEN 'file' THEN '' ELSE '#L1-L2' END END AS url FROM nodes")
def permalink(spark, sf_dir):
    kind, path = F.col("kind"), F.col("path")
    return A.star_nodes(spark, sf_dir).select("key", links.permalink("o", "r", "main", kind, path, F.lit(0), F.lit(1)).alias("url"))


_PATHS = "paths AS (SELECT string_split(source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt', '/') AS p FROM documents)"


@query("WITH " + _PATHS + " SELECT DISTINCT array_to_string(p[1:k], '/') AS dir, array_to_string(p[1:k - 1], '/') AS parent FROM paths, range(1, 9) r(k) WHERE k < len(p)")
def dir_hierarchy(spark, sf_dir):
    return paths_of.folders(A.doc_files(spark, sf_dir))


@query(_with(_NODES) + ", f AS (SELECT path, name FROM nodes WHERE kind = 'file') SELECT DISTINCT f.name AS suffix, g.path AS path FROM f JOIN f g ON g.path = f.name OR suffix(g.path, '/' || f.name)")
def suffix_join(spark, sf_dir):
    files = A.star_nodes(spark, sf_dir).where("kind = 'file'")
    return paths_of.suffix_join(files.select("path"), files.select(F.col("name").alias("suffix")))


@query(_with(_LIST + """, f AS (SELECT path FROM list UNION SELECT 'x/' || path FROM list), q AS (SELECT DISTINCT path AS "from", path AS suffix FROM list UNION SELECT DISTINCT 'x/y' AS "from", path FROM list),
 met AS (SELECT "from", suffix, path FROM q JOIN f ON path = suffix UNION SELECT "from", suffix, path FROM q JOIN f ON path = 'x/' || suffix),
 alike AS (SELECT *, (SELECT count(*) FROM range(1, least(length(path), length("from")) + 1) r(n) WHERE left(path, n) = left("from", n)) AS n FROM met)""") +
       """SELECT "from", suffix, path AS match FROM alike QUALIFY row_number() OVER (PARTITION BY "from", suffix ORDER BY n DESC, path) = 1""")
def closest_path(spark, sf_dir):
    own = A.listing(spark, sf_dir).select("path")
    files = own.unionByName(own.select(F.concat(F.lit("x/"), "path").alias("path"))).distinct()
    asked = own.select(F.col("path").alias("from"), F.col("path").alias("suffix")).unionByName(own.select(F.lit("x/y").alias("from"), F.col("path").alias("suffix"))).distinct()
    return paths_of.closest_path(files, asked)


@query(_with(_NODES) + ", roots AS (SELECT path AS prefix FROM nodes WHERE kind = 'dir' AND path <> '') SELECT path, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT path FROM nodes WHERE kind = 'file') f JOIN roots ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path")
def longest_prefix(spark, sf_dir):
    nodes = A.star_nodes(spark, sf_dir)
    return paths_of.longest_prefix(nodes.where("kind = 'file'").select("path").distinct(), nodes.where("kind = 'dir' and path <> ''").select(F.col("path").alias("prefix")))


@query(_with(_NODES) + """, dirs AS (SELECT path FROM nodes WHERE kind = 'dir' AND path <> ''), specs AS (SELECT 'a/b/' || path AS spec FROM dirs UNION SELECT path || '/none' FROM dirs UNION SELECT 'q/' || path || '/' || path FROM dirs UNION SELECT name FROM nodes WHERE kind = 'dir'),
 cut AS (SELECT spec, k, array_to_string(string_split(spec, '/')[k:], '/') AS dir FROM specs, range(1, 12) r(k)) SELECT spec, dir FROM cut WHERE dir IN (SELECT path FROM dirs) QUALIFY row_number() OVER (PARTITION BY spec ORDER BY k) = 1""")
def dir_match(spark, sf_dir):
    """Specifiers that end with a folder, that end beside one, that hold one twice, and names alone."""
    folders = A.star_nodes(spark, sf_dir).where("kind = 'dir'").select("path", "name")
    dirs = folders.where("path <> ''")
    specs = dirs.select(F.explode(F.array(F.concat(F.lit("a/b/"), "path"), F.concat("path", F.lit("/none")), F.concat(F.lit("q/"), "path", F.lit("/"), "path"))).alias("spec")).unionByName(folders.select(F.col("name").alias("spec"))).distinct()
    return paths_of.dir_match(specs, dirs.select(F.col("path").alias("dir")))


@query(_with(_NODES) + "SELECT key, rel, CASE rel WHEN './x.js' THEN path || '/x.js' WHEN '../y//z' THEN regexp_replace(path, '/?[^/]*$', '') || CASE WHEN path LIKE '%/%' THEN '/' ELSE '' END || 'y/z' WHEN '../../../../q' THEN NULL END AS joined FROM nodes, (SELECT unnest(['./x.js', '../y//z', '../../../../q']) AS rel) r WHERE kind = 'dir' AND path <> ''")
def path_join(spark, sf_dir):
    dirs = A.star_nodes(spark, sf_dir).where("kind = 'dir' and path <> ''").select("key", "path", F.explode(F.array(*map(F.lit, ["./x.js", "../y//z", "../../../../q"]))).alias("rel"))
    return dirs.select("key", "rel", P.path_join(F.col("path"), F.col("rel")).alias("joined"))


@query("WITH " + _PATHS + " SELECT min(p[1]) AS root, min(p[1]) = max(p[1]) AND bool_and(len(p) > 1) AS shared FROM paths")
def shared_root(spark, sf_dir):
    return paths_of.shared_root(A.doc_files(spark, sf_dir))


@query("SELECT key, n, key || CASE WHEN n > 1 THEN '~' || CAST(n AS VARCHAR) ELSE '' END AS unique_key FROM (SELECT k AS key, row_number() OVER (PARTITION BY k) AS n FROM (SELECT CAST(l_orderkey AS VARCHAR) || '#' || CAST(l_linenumber AS VARCHAR) AS k FROM lineitem) x) y")
def dup_key_suffix(spark, sf_dir):
    lines = A.read(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("#"), F.col("l_linenumber").cast("string")).alias("key"), "l_partkey", "l_suppkey", "l_shipdate")
    return paths_of.numbered_keys(lines, ["l_shipdate", "l_partkey", "l_suppkey"]).select("key", "n", "unique_key")


# ---- saved repositories ----------------------------------------------------------------------------------------------

_KEPT = "kept AS (SELECT user_id AS repo, max(ts) AS saved_at FROM events GROUP BY user_id ORDER BY saved_at DESC, repo LIMIT 6)"


def _saved(spark, sf_dir):
    return A.read(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.sha1(F.col("props")).alias("sha"), F.col("ts").alias("saved_at"), "event_id")


@query("WITH " + _KEPT + " SELECT repo, epoch_us(saved_at) AS saved_us FROM kept")
def cache_keep6(spark, sf_dir):
    return caching.recent(_saved(spark, sf_dir)).select("repo", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', saved_at)").alias("saved_us"))


@query("SELECT event_id FROM events WHERE sha1(props) IN (SELECT sha1(props) FROM events WHERE event_type = 'view')")
def cache_hit(spark, sf_dir):
    saved = A.read(spark, sf_dir, "events").select("event_id", "event_type", F.sha1("props").alias("sha"))
    return caching.cached(saved, saved.where("event_type = 'view'")).select("event_id")


@query("WITH saved AS (SELECT event_id, event_type, sha1(props || CAST(event_id % 4999 AS VARCHAR)) AS sha FROM events) SELECT event_id FROM saved WHERE sha NOT IN (SELECT sha FROM saved WHERE event_type = 'view')")
def cache_miss(spark, sf_dir):
    saved = A.read(spark, sf_dir, "events").select("event_id", "event_type", F.sha1(F.concat("props", (F.col("event_id") % 4999).cast("string"))).alias("sha"))
    return caching.missing(saved, saved.where("event_type = 'view'")).select("event_id")


@query("WITH " + _KEPT + ", rows AS (SELECT user_id AS repo, sha1(props || CAST(event_id % 5000 AS VARCHAR)) AS sha FROM events) SELECT DISTINCT sha FROM rows WHERE sha NOT IN (SELECT sha FROM rows WHERE repo IN (SELECT repo FROM kept))")
def blob_gc(spark, sf_dir):
    events = A.read(spark, sf_dir, "events")
    return caching.unreferenced(events.select(F.col("user_id").alias("repo"), F.sha1(F.concat("props", (F.col("event_id") % 5000).cast("string"))).alias("sha"), F.col("ts").alias("saved_at")))


# ---- drawing ---------------------------------------------------------------------------------------------------------


def _case(values: dict, other) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


_STYLE = f"SELECT key, round({_case(styling.RADII, 3.3)}::DOUBLE + least(5.0::DOUBLE, 0.8::DOUBLE * log2(1 + deg)), 6) AS radius, {_case(styling.SHAPES, 0)} AS shape, {_case({k: n for n, k in enumerate(styling.RADII)}, 6)} AS palette FROM deg JOIN nodes USING (key)"


@query(_with(_FILES + _DEG) + _STYLE)
def node_style(spark, sf_dir):
    shown, edges = _files_view(spark, sf_dir)
    return styling.node_style(shown, views.degree(shown, edges))


@query(_with(_bfs(2) + _NBE) + f"""SELECT s, t, round(CASE WHEN hot THEN least(0.95::DOUBLE, a * 2.6 + 0.15) ELSE a END, 6) AS alpha, CASE WHEN hot THEN 1.8::DOUBLE ELSE 1.1::DOUBLE END AS width, hot FROM (
 SELECT s, t, s = '{START}' OR t = '{START}' AS hot, (CASE type WHEN 3 THEN 0.34 WHEN 1 THEN 0.3 ELSE 0.2 END)::DOUBLE * greatest(0.35::DOUBLE, 1 - 0.13::DOUBLE * greatest(0, greatest(x.depth, y.depth) - 1)) AS a FROM nbe JOIN nb x ON x.key = s JOIN nb y ON y.key = t) z""")
def edge_style(spark, sf_dir):
    edges = _checked(spark, sf_dir)[1]
    nb = neighborhood.bfs(edges, START, 2)
    return styling.edge_style(neighborhood.induced(edges, nb), nb, START)


@query(_with(_bfs(2) + _NBE) + """, nd AS (SELECT key, count(*) AS deg FROM (SELECT s AS key FROM nbe UNION ALL SELECT t FROM nbe) x GROUP BY key)
 SELECT s, t, round(1.0::DOUBLE / least(a.deg, b.deg), 6) AS strength, round(a.deg::DOUBLE / (a.deg + b.deg), 6) AS bias, round(50 + 5 * sqrt(least(a.deg, b.deg)), 6) AS length FROM nbe JOIN nd a ON a.key = s JOIN nd b ON b.key = t""")
def spring_params(spark, sf_dir):
    edges = _checked(spark, sf_dir)[1]
    nb = neighborhood.bfs(edges, START, 2)
    inside = neighborhood.induced(edges, nb)
    return styling.springs(inside, views.degree(nb, inside))


@query(_with(_bfs(3)) + """, cnt AS (SELECT depth, count(*) AS n FROM nb WHERE depth > 0 GROUP BY depth),
 ring AS (SELECT depth, 30.0::DOUBLE AS inner_r, greatest(120.0::DOUBLE, sqrt(900 + n * 34 * 34 / pi())) AS outer_r FROM cnt WHERE depth = 1
 UNION ALL SELECT c.depth, outer_r + 24, greatest(outer_r + 114, sqrt((outer_r + 24) * (outer_r + 24) + c.n * 34 * 34 / pi())) FROM ring JOIN cnt c ON c.depth = ring.depth + 1)
 SELECT depth, round(inner_r, 4) AS "inner", round(outer_r, 4) AS "outer" FROM ring""")
def ring_radii(spark, sf_dir):
    return styling.ring_radii(neighborhood.bfs(_files_view(spark, sf_dir)[1], START, 3))


def _points(spark, sf_dir):
    """Customers at whole-number places made from their keys."""
    k = F.col("c_custkey")
    return A.read(spark, sf_dir, "customer").select(F.concat(F.lit("f:"), "c_name").alias("key"), ((k * 7919) % 2003 - 1000).cast("double").alias("x"), ((k * 104729) % 1999 - 1000).cast("double").alias("y"))


_POINTS = "WITH pts AS (SELECT 'f:' || c_name AS key, CAST((c_custkey * 7919) % 2003 - 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1999 - 1000 AS DOUBLE) AS y FROM customer) "


@query(_POINTS + "SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, round(greatest(0.03::DOUBLE, least((1280 - 100) / greatest(1.0::DOUBLE, max(x) - min(x)), (800 - 100) / greatest(1.0::DOUBLE, max(y) - min(y)), 2.5::DOUBLE)), 6) AS scale FROM pts")
def fit_box(spark, sf_dir):
    return styling.fit_box(_points(spark, sf_dir), 1280.0, 800.0)


@query(_POINTS + "SELECT key FROM pts WHERE sqrt((x - 10) ** 2 + (y + 20) ** 2) <= 900 ORDER BY (x - 10) ** 2 + (y + 20) ** 2, key LIMIT 1")
def nearest(spark, sf_dir):
    return styling.nearest(_points(spark, sf_dir), 10.0, -20.0, 900.0)


@query(_POINTS + ", d AS (SELECT key, sqrt(x * x + y * y) AS d, x / sqrt(x * x + y * y) AS c FROM pts WHERE x <> 0 OR y <> 0) SELECT key FROM d WHERE c >= 0.5 ORDER BY round(d * (1.7 - c), 9), key LIMIT 1")
def directional(spark, sf_dir):
    return styling.directional(_points(spark, sf_dir), 0.0, 0.0, 1.0, 0.0)


@query(_with(_bfs(2)) + f", st AS ({_STYLE}) SELECT key, row_number() OVER (ORDER BY depth, radius DESC, key) AS rn FROM st JOIN nb USING (key) QUALIFY rn <= 220")
def label_order(spark, sf_dir):
    shown, edges = _files_view(spark, sf_dir)
    ends = neighborhood.around(edges)
    return styling.label_order(styling.node_style(shown, views.degree_of(shown, ends)), neighborhood.bfs(edges, START, 2, ends), 1280.0, 800.0)


# ---- set operations --------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT 'l:' || p_brand AS key FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' INTERSECT SELECT 'l:' || p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'N'")
def semi_intersect(spark, sf_dir):
    """Brands with links of both kinds."""
    line, part = A.read(spark, sf_dir, "lineitem"), A.read(spark, sf_dir, "part")
    of = lambda flag: part.join(line.where(F.col("l_returnflag") == flag), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.concat(F.lit("l:"), "p_brand").alias("key"))
    return of("R").intersect(of("N"))


@query("SELECT 'f:' || c_name AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_except(spark, sf_dir):
    """Files without symbols of a status."""
    orders = A.read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return A.read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.concat(F.lit("f:"), "c_name").alias("key"))


# ---- more lookups, sources and sinks ---------------------------------------------------------------------------------

#: Orders as symbols of made-up lines in their customers' files.
_SPANS = """sym AS (SELECT 's:' || o_orderkey AS key, 'f:' || c_name AS file_key, o_orderkey % 300 AS line, o_orderkey % 300 + o_orderkey % 7 * 20 AS "end" FROM orders JOIN customer ON o_custkey = c_custkey),
 clicks AS (SELECT event_id AS click_id, 'f:' || c_name AS file_key, event_id % 330 AS line FROM events JOIN customer ON c_custkey = event_id % 200 + 1)"""


def _symbols(spark, sf_dir):
    customer, key = A.read(spark, sf_dir, "customer"), F.col("o_orderkey")
    orders = A.read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    symbols = orders.select(F.concat(F.lit("s:"), key).alias("key"), F.concat(F.lit("f:"), "c_name").alias("file_key"), (key % 300).alias("line"), (key % 300 + key % 7 * 20).alias("end"))
    events = A.read(spark, sf_dir, "events").join(customer, F.col("c_custkey") == F.col("event_id") % 200 + 1)
    return symbols, events.select(F.col("event_id").alias("click_id"), F.concat(F.lit("f:"), "c_name").alias("file_key"), (F.col("event_id") % 330).alias("line"))


@query("WITH " + _SPANS + """ SELECT click_id, coalesce(key, clicks.file_key) AS key FROM clicks LEFT JOIN sym ON sym.file_key = clicks.file_key AND clicks.line BETWEEN sym.line AND "end"
 QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY "end" - sym.line, sym.line, key) = 1""")
def line_click(spark, sf_dir):
    return lookup.line_click(*_symbols(spark, sf_dir))


@query(_with(_EDGES) + "SELECT s, t, type FROM edges JOIN nodes a ON a.key = s JOIN nodes b ON b.key = t WHERE s <> t AND a.parent_key IS DISTINCT FROM t AND b.parent_key IS DISTINCT FROM s")
def without_kin(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return lookup.without_kin(edges, nodes)


@query(_with(_NODES) + "SELECT key, kind FROM nodes WHERE key IN (SELECT 's:' || l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def by_key(spark, sf_dir):
    asked = A.read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.concat(F.lit("s:"), "l_orderkey").alias("key"))
    return lookup.by_key(A.star_nodes(spark, sf_dir), asked).select("key", "kind")


@query("SELECT doc_id, substr(regexp_replace(coalesce(string_split(coalesce(text, ''), chr(10))[doc_id % 3 + 1], ''), '^\\s+|\\s+$', '', 'g'), 1, 160) AS code FROM documents")
def first_lines(spark, sf_dir):
    files = A.doc_files(spark, sf_dir)
    symbols = files.select(F.col("doc_id").alias("key"), "path", (F.col("doc_id") % 3).cast("int").alias("line"))
    return lookup.first_lines(symbols, files).select(F.col("key").alias("doc_id"), "code")


@query(_with(_LIST) + "SELECT DISTINCT path FROM list WHERE path IN (SELECT replace(path, 'src1/', 'src2/') FROM list)")
def exact_join(spark, sf_dir):
    own = A.listing(spark, sf_dir).select("path")
    return paths_of.exact_join(own, own.select(F.replace("path", F.lit("src1/"), F.lit("src2/")).alias("path")))


@query("""SELECT p AS path, min(doc_id) AS doc_id FROM (SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS p, doc_id FROM documents) x GROUP BY p""")
def files_by_path(spark, sf_dir):
    docs = A.read(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))).alias("path"), "doc_id", F.col("doc_id").alias("seq"))
    return paths_of.files_by_path(docs).select("path", "doc_id")


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def total_bytes(spark, sf_dir):
    return caching.total_bytes(A.read(spark, sf_dir, "documents").select(F.col("n_chars").alias("size")))


@query(_POINTS + "SELECT key, (x - 10) * 0.5 + 640 AS sx, (y + 20) * 0.5 + 400 AS sy FROM pts")
def to_screen(spark, sf_dir):
    return styling.to_screen(_points(spark, sf_dir), 10.0, -20.0, 0.5, 1280.0, 800.0)


@query(_POINTS + "SELECT key, greatest(0.03::DOUBLE, least(8.0::DOUBLE, x * 0.01)) AS scale FROM pts")
def clamped_zoom(spark, sf_dir):
    return _points(spark, sf_dir).select("key", styling.clamped_zoom(F.col("x"), F.lit(0.01)).alias("scale"))


@query("""WITH owners AS (SELECT DISTINCT 'o' || CAST(c_nationkey AS VARCHAR) AS owner, c_nationkey AS n FROM customer), manifest AS (SELECT owner, CASE WHEN n % 2 = 0 THEN 'a/b' ELSE 'a' END AS ref, CASE WHEN n % 2 = 0 THEN 'c' ELSE 'b/c' END AS sub FROM owners),
 cand AS (SELECT owner, k, array_to_string(p[1:k], '/') AS ref, array_to_string(p[k + 1:], '/') AS sub FROM (SELECT owner, ['a', 'b', 'c'] AS p FROM owners) o, range(1, 7) r(k) WHERE k <= len(p))
 SELECT owner, 'r' AS repo, ref, sub, '' AS focus FROM cand JOIN manifest USING (owner, ref, sub) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY k) = 1""")
def known_tree(spark, sf_dir):
    """Even owners have a branch a/b, odd ones a."""
    nation = F.col("c_nationkey")
    owners = A.read(spark, sf_dir, "customer").select(nation, F.concat(F.lit("o"), nation).alias("owner"), F.lit("r").alias("repo")).distinct()
    specs = owners.select("owner", "repo", F.lit("a").alias("ref"), F.lit("b/c").alias("sub"), F.lit("").alias("focus"))
    even = nation % 2 == 0
    manifest = owners.select("owner", "repo", F.when(even, "a/b").otherwise("a").alias("ref"), F.when(even, "c").otherwise("b/c").alias("sub"))
    return links.known_tree(specs, manifest)


@query(_with(_NODES) + """SELECT key, 'map?repo=o%2Fr&node=' || replace(replace(replace(replace(replace(key, '%', '%25'), ':', '%3A'), '/', '%2F'), '#', '%23'), ' ', '+') || '&map=code&depth=2' AS link, key AS node, 2 AS depth FROM nodes""")
def share_link(spark, sf_dir):
    link = links.share_link("map", F.lit("o"), F.lit("r"), F.lit("HEAD"), F.lit(""), F.col("key"), F.lit("code"), F.lit(2))
    back = links.shared_view(F.col("link"))
    return A.star_nodes(spark, sf_dir).select("key", link.alias("link")).select("key", "link", back["node"].alias("node"), back["depth"].alias("depth"))


@query("WITH b AS (SELECT sha1(props) AS sha, any_value(props) AS text FROM events WHERE event_type = 'view' GROUP BY 1) SELECT event_id, text FROM events JOIN b ON sha1(props) = sha")
def load_saved(spark, sf_dir):
    events = A.read(spark, sf_dir, "events").select("event_id", "event_type", "props", F.sha1("props").alias("sha"))
    blobs = events.where("event_type = 'view'").groupBy("sha").agg(F.first("props").alias("text"))
    return caching.load(events.select(F.col("event_id").alias("path"), "sha"), blobs).select(F.col("path").alias("event_id"), "text")


@query("SELECT source || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents")
def saved_files(spark, sf_dir):
    """Saved twice and loaded again."""
    docs = A.read(spark, sf_dir, "documents")
    files = docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    store = new_path(spark)
    for at in (1.0, 2.0):
        caching.save(files, store, "r", at)
    return caching.load_saved(spark, store, "r")


# ---- imports ---------------------------------------------------------------------------------------------------------


def _sql_text(template: str) -> str:
    """A head of adapters.code_files as SQL."""
    names = {"@source": "source", "@lang": "lang"}
    value = lambda x: names.get(x) or (f"CAST(doc_id - ({x[2:]}) AS VARCHAR)" if A._PLACE.fullmatch(x) else "'" + x.replace("'", "''") + "'")
    return " || ".join(value(x) for x in A._PLACE.split(template) if x)


def _re2(group: str, k: int) -> str:
    """A pattern without what Java needs and RE2 lacks."""
    return I.pattern(group, k).replace("*+", "*").replace("(?mdi)", "(?mi)").replace("(?md)", "(?m)").replace("'", "''")


_GROUPS = {"lua": ("lua",), "sh": ("sh",), "css": ("css", "scss"), "md": ("md",), "html": ("html",)}
_CODE_FILES = f"""d AS (SELECT doc_id, ((doc_id % 6) + 6) % 6 AS k, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS body, CAST(doc_id AS VARCHAR) AS i FROM documents WHERE doc_id IS NOT NULL),
 files AS (SELECT CASE k WHEN 0 THEN CASE WHEN doc_id % 12 = 0 THEN 'src/' || source || '/d' || i || '/util.lua' WHEN doc_id % 18 = 6 THEN 'src/' || source || '/m' || i || '/init.lua' ELSE 'src/' || source || '/m' || i || '.lua' END
   WHEN 1 THEN 'bin/' || lang || '/s' || i || '.sh' WHEN 2 THEN 'web/' || source || CASE WHEN doc_id % 4 = 2 THEN '/_c' || i || '.css' ELSE '/c' || i || '.scss' END
   WHEN 3 THEN CASE WHEN doc_id % 4 = 3 THEN 'docs/p' || i || '/README.md' ELSE 'docs/' || source || '/' || lang || '/p' || i || '.md' END
   WHEN 4 THEN 'web/h' || i || '.html' ELSE CASE WHEN doc_id % 4 = 1 THEN 'web/app' || i || '/index.js' ELSE 'web/app' || i || '.ts' END END AS path,
   CASE k {" ".join(f"WHEN {k} THEN {_sql_text(h)}" for k, h in enumerate(A.HEADS))} END || body AS text FROM d
  UNION ALL SELECT 'site/' || CAST(page_id AS VARCHAR) || '.html', '<link href="/web/app' || CAST(page_id * 6 + 5 AS VARCHAR) || '"/>' || coalesce(html, '') FROM pages),
 typed AS (SELECT path, text, CASE regexp_extract(path, '[^.]*$') {" ".join(f"WHEN '{e}' THEN '{g}'" for g, es in _GROUPS.items() for e in es)} END AS grp FROM files),
 listed AS (SELECT path, grp, CASE grp {" ".join(f"WHEN '{g}' THEN " + " || ".join(f"list_filter(regexp_extract_all(text, '{_re2(g, k)}', 1), lambda x: x <> '')" for k in range(len(I.IMPORT[g]))) for g in _GROUPS)} END AS specs FROM typed),
 imported AS (SELECT path, grp, CAST(unnest(range(len(specs))) AS INTEGER) AS n, trim(unnest(specs)) AS spec FROM listed WHERE grp IS NOT NULL)"""


def _sql_endings(path: str, endings: list[str]) -> str:
    return ", ".join(f"{path} || '{e}'" for e in endings)


# join(folder, spec), by its segments: "." and empty ones go, ".." takes the last one off, and off the root there is none
_SQL_JOIN = """(SELECT CASE WHEN way.bad THEN NULL ELSE array_to_string(way.segs, '/') END FROM (SELECT list_reduce(list_prepend({'segs': CASE WHEN folder = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(folder, '/') END, 'bad': FALSE, 's': ''},
   list_transform(string_split(%s, '/'), lambda x: {'segs': CAST([] AS VARCHAR[]), 'bad': FALSE, 's': x})),
   lambda a, b: {'segs': CASE WHEN b.s IN ('', '.') THEN a.segs WHEN b.s = '..' THEN a.segs[1:len(a.segs) - 1] ELSE list_append(a.segs, b.s) END, 'bad': a.bad OR (b.s = '..' AND len(a.segs) = 0), 's': ''}) AS way) q)"""
_HERE = lambda s: f"CASE WHEN starts_with({s}, '/') THEN substr({s}, 2) ELSE {_SQL_JOIN % s} END"
_RESOLVED = _CODE_FILES + f""", asked AS (SELECT DISTINCT path, grp, spec, regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_matches(spec, '{imports.EXTERNAL}') AS away FROM imported WHERE spec <> ''),
 based AS (SELECT *, CASE grp WHEN 'lua' THEN replace(spec, '.', '/') WHEN 'sh' THEN {_SQL_JOIN % "spec"} WHEN 'css' THEN {_HERE("spec")}
   WHEN 'md' THEN regexp_replace({_HERE("coalesce(CASE WHEN regexp_matches(split_part(spec, '#', 1), '%(?:[^0-9A-Fa-f]|[0-9A-Fa-f](?:[^0-9A-Fa-f]|$)|$)') THEN NULL ELSE url_decode(split_part(spec, '#', 1)) END, split_part(spec, '#', 1))")}, '/$', '')
   WHEN 'html' THEN regexp_replace({_HERE("regexp_replace(spec, '[?#].*$', '')")}, '/$', '') END AS b FROM asked),
 options AS (SELECT path, grp, spec, unnest(CASE WHEN grp = 'lua' THEN [b || '.lua', b || '/init.lua'] WHEN grp = 'sh' AND NOT contains(spec, '$') THEN [b, regexp_replace(spec, '^([.][.]?/)+', '')]
   WHEN grp = 'css' AND NOT away THEN [{_sql_endings("b", imports.STYLE_ENDINGS)}, {_sql_endings("regexp_replace(b, '^(.*/)?', '" + chr(92) + "1_')", imports.STYLE_ENDINGS)}] WHEN grp = 'md' AND NOT away THEN [b, b || '/README.md']
   WHEN grp = 'html' AND NOT away THEN [b, {_sql_endings("b", imports.SCRIPT_ENDINGS)}, {_sql_endings("CASE b WHEN '' THEN 'index' ELSE b || '/index' END", imports.SCRIPT_ENDINGS)},
    {", ".join("CASE WHEN regexp_matches(b, '" + chr(92) + ".[mc]?jsx?$') THEN regexp_replace(b, '" + chr(92) + ".[mc]?jsx?$', '') || '" + e + "' END" for e in imports.TYPED_ENDINGS)}] END) AS want, unnest(range(40)) AS nth FROM based),
 met AS (SELECT o.path, grp, spec, nth, f.path AS target FROM options o JOIN (SELECT DISTINCT path FROM files) f ON CASE WHEN grp = 'lua' OR (grp = 'sh' AND nth = 1) THEN f.path = want OR suffix(f.path, '/' || want) ELSE f.path = want END WHERE want IS NOT NULL),
 chosen AS (SELECT path, grp, spec, target FROM met QUALIFY row_number() OVER (PARTITION BY path, grp, spec ORDER BY nth, (SELECT count(*) FROM range(1, least(length(path), length(target)) + 1) r(n) WHERE left(path, n) = left(target, n)) DESC, target) = 1),
 resolved AS (SELECT a.path, a.grp, a.spec, target, CASE WHEN target IS NULL AND a.grp = 'lua' AND split_part(a.spec, '.', 1) <> '' THEN split_part(a.spec, '.', 1) END AS lib FROM asked a LEFT JOIN chosen c ON a.path = c.path AND a.spec = c.spec)"""


def _imports(spark, sf_dir):
    """The files, whose paths need no text and are not written, and their imports."""
    files = A.code_files(spark, sf_dir)
    return files, cut(imports.imports_of(files))


@query("WITH " + _CODE_FILES + " SELECT path, grp, n, spec FROM imported WHERE spec <> ''")
def imports_of(spark, sf_dir):
    """What the files of five languages import."""
    return imports.imports_of(A.code_files(spark, sf_dir))


@query("WITH " + _RESOLVED + " SELECT path, grp, spec, target, lib FROM resolved WHERE target IS NOT NULL OR lib IS NOT NULL")
def resolve_paths(spark, sf_dir):
    """The file or library that each import names."""
    files, found = _imports(spark, sf_dir)
    return imports.resolve_paths(found, files)


@query("WITH " + _RESOLVED + " SELECT DISTINCT 'f:' || path AS s, coalesce('f:' || target, 'l:' || lib) AS t, CASE WHEN grp = 'md' AND target IS NOT NULL THEN 1 ELSE 3 END AS type FROM resolved WHERE (target IS NOT NULL AND target <> path) OR lib IS NOT NULL")
def import_edges(spark, sf_dir):
    """A file's links to what it imports."""
    files, found = _imports(spark, sf_dir)
    return imports.import_edges(imports.resolve_paths(found, files))


# ---- identifiers -----------------------------------------------------------------------------------------------------

_SYMBOLS = """files AS (SELECT c_custkey, 'f:' || CAST(c_custkey AS VARCHAR) AS file, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'go' WHEN 'BUILDING' THEN 'jvm' WHEN 'FURNITURE' THEN 'js' WHEN 'HOUSEHOLD' THEN 'c' WHEN 'MACHINERY' THEN 'py' END AS grp,
  n_name AS folder, CASE WHEN c_mktsegment = 'BUILDING' THEN 'p' || CAST(c_nationkey % 5 AS VARCHAR) END AS package FROM customer JOIN nation ON c_nationkey = n_nationkey),
 own AS (SELECT o.*, file FROM orders o JOIN files ON o_custkey = c_custkey),
 first AS (SELECT file, min(o_orderkey) AS class FROM own WHERE o_orderpriority LIKE '1%' GROUP BY file),
 defs AS (SELECT 's:' || CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'h' || CAST(o_orderkey % 40 AS VARCHAR) WHEN 2 THEN 'n' || CAST(o_orderkey % 1000 AS VARCHAR) WHEN 3 THEN 'a' || CAST(o_orderkey AS VARCHAR) ELSE 'g' || CAST(o_custkey % 300 AS VARCHAR) END AS name,
  own.file, CASE WHEN regexp_matches(o_orderpriority, '^[345]') AND class < o_orderkey THEN 's:' || CAST(class AS VARCHAR) ELSE own.file END AS parent_key, o_orderstatus <> 'P' AS shown FROM own LEFT JOIN first ON own.file = first.file),
 uses AS (SELECT file, 's:' || CAST(l_orderkey AS VARCHAR) AS owner, CASE l_linenumber % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'h' || CAST(l_partkey % 40 AS VARCHAR) WHEN 2 THEN 'n' || CAST(l_partkey * 7 % 1000 AS VARCHAR) WHEN 3 THEN 'a' || CAST(l_orderkey + 3 - l_orderkey % 5 AS VARCHAR) ELSE 'g' || CAST((l_suppkey * 3 + l_partkey) % 300 AS VARCHAR) END AS name,
  l_returnflag = 'R' AS member FROM lineitem JOIN own ON l_orderkey = o_orderkey),
 imported AS (SELECT DISTINCT file, 'f:' || CAST(unnest([c_custkey + 1, c_custkey + 5, c_custkey + 10, c_custkey * 2]) AS VARCHAR) AS target FROM files),
 hidden AS (SELECT 's:' || CAST(o_orderkey AS VARCHAR) AS key, unnest(['h' || CAST(o_orderkey % 40 AS VARCHAR), 'n' || CAST(o_orderkey % 1000 AS VARCHAR), 'h1']) AS name FROM own WHERE o_orderkey % 3 = 0),
 external AS (SELECT file, unnest(['h' || CAST(c_custkey % 40 AS VARCHAR), 'g' || CAST(c_custkey % 300 AS VARCHAR), 'h3']) AS name FROM files WHERE c_custkey % 4 = 0),
 chain AS (SELECT key, key AS around FROM defs UNION SELECT chain.key, d.parent_key FROM chain JOIN defs d ON d.key = chain.around),
 open_uses AS (SELECT * FROM uses u WHERE NOT EXISTS (SELECT 1 FROM chain JOIN hidden ON hidden.key = chain.around WHERE chain.key = u.owner AND hidden.name = u.name)),
 free_uses AS (SELECT * FROM open_uses u WHERE NOT EXISTS (SELECT 1 FROM external e WHERE e.file = u.file AND e.name = u.name) OR EXISTS (SELECT 1 FROM defs d WHERE d.file = u.file AND d.name = u.name))"""
# every use with every candidate of its name, and which rule it comes by; the first rule with a candidate counts
_MEANT = _SYMBOLS + """, pairs AS (
  SELECT u.file, u.owner, u.name, u.member, d.key, 0 AS tier FROM free_uses u JOIN defs d ON d.file = u.file AND d.name = u.name
  UNION ALL SELECT u.file, u.owner, u.name, u.member, d.key, unnest(CASE WHEN i.target IS NOT NULL THEN [1, 3] ELSE [3] END || CASE WHEN a.grp IN ('go', 'jvm', 'cs', 'swift') AND CASE WHEN a.package IS NOT NULL THEN a.package = b.package AND (u.member OR d.parent_key = d.file) ELSE a.folder = b.folder END THEN [2] ELSE [] END)
   FROM (SELECT DISTINCT file, owner, name, member FROM free_uses) u JOIN files a ON a.file = u.file JOIN defs d ON d.name = u.name AND d.shown JOIN files b ON b.file = d.file AND a.grp = b.grp LEFT JOIN imported i ON i.file = u.file AND i.target = d.file),
 counted AS (SELECT DISTINCT *, count(DISTINCT key) OVER (PARTITION BY file, owner, name, member, tier) AS n, max(CASE WHEN tier = 3 THEN 1 ELSE 0 END * 0) OVER (PARTITION BY file, owner, name, member) AS z, min(tier) OVER (PARTITION BY file, owner, name, member) AS best FROM pairs),
 meant AS (SELECT c.owner, c.key, CASE WHEN tier = 3 AND (n > 1 OR grp IN ('js', 'py', 'rs', 'jvm')) THEN 1 ELSE 3 END AS type FROM counted c JOIN files f ON f.file = c.file
  WHERE tier = best),
 linked AS (SELECT m.owner, m.key, max(m.type) AS type FROM meant m LEFT JOIN defs d ON d.key = m.key LEFT JOIN defs o ON o.key = m.owner WHERE m.owner <> m.key AND d.parent_key <> m.owner AND o.parent_key <> m.key GROUP BY m.owner, m.key)"""
_MEANT = _MEANT.replace(" max(CASE WHEN tier = 3 THEN 1 ELSE 0 END * 0) OVER (PARTITION BY file, owner, name, member) AS z,", "")


def _symbol_tables(spark, sf_dir, *often):
    """The symbol tables, of which those used more than once are written."""
    return {n: cut(df) if n in often else df for n, df in A.symbol_tables(spark, sf_dir).items()}


def _unshadowed(t, uses):
    return identifiers.unshadowed(uses, t["defs"].select("key", "parent_key"), t["locals"])


@query("WITH RECURSIVE " + _SYMBOLS + " SELECT DISTINCT owner, name FROM open_uses")
def unshadowed_uses(spark, sf_dir):
    """Names that no symbol around their use has for a parameter or variable."""
    t = _symbol_tables(spark, sf_dir, "uses", "locals")
    return _unshadowed(t, t["uses"]).select("owner", "name").distinct()


@query("WITH RECURSIVE " + _SYMBOLS + " SELECT DISTINCT owner, name FROM free_uses")
def free_uses(spark, sf_dir):
    """Of those, the ones that are not a library's."""
    t = _symbol_tables(spark, sf_dir, "uses", "defs", "locals")
    # the libraries' names go first, so that what is left is dealt by owner and name when its repeats go
    return _unshadowed(t, identifiers.without_external(t["uses"], t["defs"], t["external"])).select("owner", "name").distinct()


@query("WITH RECURSIVE " + _MEANT + " SELECT owner, key, type FROM linked")
def identifier_links(spark, sf_dir):
    """The links of uses to definitions, to all candidates, however many."""
    t = _symbol_tables(spark, sf_dir, "uses", "defs", "files", "locals")
    return identifiers.meanings(identifiers.without_external(_unshadowed(t, t["uses"]), t["defs"], t["external"]), t["defs"], t["files"], t["imported"], capped=False)


# ---- bodies of definitions -------------------------------------------------------------------------------------------

_LISTED = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_BLOCKS = rf"""raw AS (SELECT doc_id AS file, ['js', 'py', 'rb', 'c', 'go', 'sql'][((doc_id % 6) + 6) % 6 + 1] AS grp, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL),
 said AS (SELECT file, grp, CAST(unnest(range(len(parts))) AS INTEGER) AS line, unnest(parts) AS said FROM raw),
 l AS (SELECT *, length(regexp_extract(text, '^[ \t]*')) + 3 * (length(regexp_extract(text, '^[ \t]*')) - length(replace(regexp_extract(text, '^[ \t]*'), chr(9), ''))) AS depth, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM (
  SELECT file, grp, line, length(said) % 3 = 1 AS defines, CASE WHEN said = '' THEN '' ELSE {_LISTED(A.LEADS)}[(length(said) * 7 + line * 3) % {len(A.LEADS)} + 1] || {_LISTED(A.STARTS)}[(length(said) + line) % {len(A.STARTS)} + 1] || CASE WHEN length(said) % 5 > 0 THEN said ELSE '' END END AS text FROM said) x),
 m AS (SELECT *, CASE WHEN grp IN ('js', 'go') THEN regexp_matches(bare, '^([A-Za-z_$][A-Za-z0-9_$]*:\s*$|case\b|default\s*:)') WHEN grp = 'c' THEN regexp_matches(bare, '^(#|[A-Za-z_][A-Za-z0-9_]*:\s*$|case\b|default\s*:)') WHEN grp = 'rb' THEN regexp_matches(bare, '^(rescue|ensure|elsif|when|else)\b') ELSE FALSE END AS skip,
  starts_with(bare, '{{') AS brace, regexp_matches(bare, '^[)\]}}]') AS closes, regexp_matches(bare, '([\[{{(:]|=>)$') AS opens, regexp_matches(bare, '^end\b') AS word FROM l WHERE bare <> ''),
 stops AS (SELECT d.file, d.line, d.depth, min(k.line) AS stop FROM m d JOIN m k ON k.file = d.file AND k.line > d.line WHERE d.defines AND (k.depth < d.depth OR (k.depth = d.depth AND NOT k.skip AND NOT (k.closes AND k.opens)
   AND NOT (k.brace AND NOT EXISTS (SELECT 1 FROM m x WHERE x.file = d.file AND x.line > d.line AND x.line < k.line AND NOT (x.depth = d.depth AND x.skip))))) GROUP BY ALL),
 bodies AS (SELECT d.file, d.line, coalesce(max(x.line), d.line) AS "end" FROM (SELECT * FROM m WHERE defines) d LEFT JOIN stops s ON s.file = d.file AND s.line = d.line
  LEFT JOIN m x ON x.file = d.file AND x.line > d.line AND ((x.line < coalesce(s.stop, 2147483647) AND NOT (x.depth = d.depth AND x.skip)) OR (x.line = s.stop AND x.depth = d.depth AND (x.closes OR x.word))) GROUP BY d.file, d.line)"""


def _bodies(spark, sf_dir):
    lines, defs = A.indented_lines(spark, sf_dir)
    return blocks.block_ends(lines, defs)


@query("WITH " + _BLOCKS + ' SELECT file, line, "end" FROM bodies')
def block_ends(spark, sf_dir):
    """The last line of each definition's body."""
    return _bodies(spark, sf_dir)


@query("WITH " + _BLOCKS + ' SELECT d.file, d.line AS nth, max(p.line) AS up FROM bodies d LEFT JOIN bodies p ON p.file = d.file AND p.line < d.line AND p."end" >= d.line GROUP BY d.file, d.line')
def enclosing(spark, sf_dir):
    """The definition around each definition."""
    return blocks.enclosing(cut(_bodies(spark, sf_dir)).withColumn("nth", F.col("line")))


# ---- packages --------------------------------------------------------------------------------------------------------

_PACKAGES = """d AS (SELECT doc_id AS i, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents WHERE doc_id IS NOT NULL),
 go AS (SELECT *, 'go/' || source || '/' || lang || '/g' || CAST(i AS VARCHAR) || CASE WHEN i % 7 = 0 THEN '_test.go' ELSE '.go' END AS path FROM d),
 jvm AS (SELECT *, 'java/' || source || '/com/' || lang || '/pkg' || CAST(((i % 5) + 5) % 5 AS VARCHAR) || '/C' || CAST(i AS VARCHAR) || CASE WHEN i % 3 = 0 THEN '.kt' ELSE '.java' END AS path FROM d),
 files AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder FROM go UNION SELECT path, regexp_replace(path, '/[^/]*$', '') FROM jvm),
 modules AS (SELECT DISTINCT 'go/' || source AS dir, 'example.org/' || source AS module FROM d UNION SELECT DISTINCT 'go/' || source || '/en', 'example.org/' || source || '/en/v2' FROM d WHERE lang = 'en'),
 go_asked AS (SELECT DISTINCT path, unnest(['example.org/' || source || '/' || lang, 'example.org/' || source || '/en/v2', 'fmt', 'net/' || lang, 'github.com/a/' || lang || '/c/d', 'example.org/' || source || '/none', 'example.org/' || source || 'x']) AS spec FROM go),
 jvm_asked AS (SELECT DISTINCT path, unnest(['com.' || lang || '.pkg' || CAST((((i + 1) % 5) + 5) % 5 AS VARCHAR) || '.C' || CAST(i - 4 AS VARCHAR), 'com.' || lang || '.pkg' || CAST(((i % 5) + 5) % 5 AS VARCHAR) || '.*', 'com.en.pkg' || CAST(((i % 5) + 5) % 5 AS VARCHAR) || '.T' || CAST(((i % 40) + 40) % 40 AS VARCHAR),
   'com.' || lang || '.pkg' || CAST(((i % 5) + 5) % 5 AS VARCHAR) || '.C' || CAST(i AS VARCHAR) || '.inner.deep', 'org.junit.Test', 'kotlin', 'com.en.pkg1.T' || CAST(i AS VARCHAR) || 'x']) AS spec FROM jvm),
 top AS (SELECT 'T' || CAST(((i % 40) + 40) % 40 AS VARCHAR) AS name, path, regexp_replace(path, '/[^/]*$', '') AS folder FROM jvm WHERE i % 4 > 0)"""


@query("WITH " + _PACKAGES + """, specs AS (SELECT DISTINCT spec FROM go_asked), fit AS (SELECT spec, dir, module FROM specs LEFT JOIN modules ON spec = module OR starts_with(spec, module || '/') QUALIFY row_number() OVER (PARTITION BY spec ORDER BY length(module) DESC, dir) = 1),
 packs AS (SELECT folder, path AS target FROM files WHERE path LIKE '%.go' AND NOT suffix(path, '_test.go') QUALIFY row_number() OVER (PARTITION BY folder ORDER BY path) <= 60),
 met AS (SELECT spec, target, CAST(NULL AS VARCHAR) AS lib FROM fit JOIN packs ON folder = dir || substr(spec, length(module) + 1) UNION ALL SELECT spec, NULL, CASE WHEN contains(split_part(spec, '/', 1), '.') THEN array_to_string(string_split(spec, '/')[1:3], '/') ELSE spec END FROM fit WHERE module IS NULL)
 SELECT path, spec, target, lib FROM go_asked JOIN met USING (spec)""")
def go_targets(spark, sf_dir):
    """The files of an imported package, by the longest module; else its library."""
    t = A.package_tables(spark, sf_dir)
    return packages.go_targets(t["go"], t["files"], t["modules"])


@query("WITH " + _PACKAGES + """, n AS (SELECT *, string_split(regexp_replace(spec, '[.][*]$|[.]$', ''), '.') AS parts, suffix(spec, '.*') AS wild FROM jvm_asked),
 opts AS (SELECT path, spec, k, e, array_to_string(parts[1:k], '/') || ['.java', '.kt', '.scala', '.groovy'][e] AS want FROM n, range(1, 9) r(k), range(1, 5) q(e) WHERE k <= len(parts) AND k >= CASE WHEN len(parts) >= 2 THEN greatest(2, len(parts) - 2) ELSE 1 END),
 cls AS (SELECT o.path, spec, f.path AS target FROM opts o JOIN files f ON f.path = want OR suffix(f.path, '/' || want) QUALIFY row_number() OVER (PARTITION BY o.path, spec ORDER BY k DESC, e, (SELECT count(*) FROM range(1, least(length(o.path), length(f.path)) + 1) r(n) WHERE left(o.path, n) = left(f.path, n)) DESC, f.path) = 1),
 rest AS (SELECT *, array_to_string(CASE WHEN wild THEN parts ELSE parts[1:len(parts) - 1] END, '/') AS package, parts[len(parts)] AS name FROM n ANTI JOIN cls USING (path, spec)),
 ends AS (SELECT DISTINCT package, folder FROM (SELECT DISTINCT package FROM rest WHERE package <> '') p JOIN files f ON f.folder = package OR suffix(f.folder, '/' || package)),
 packs AS (SELECT package, path AS target FROM ends JOIN files USING (folder) QUALIFY row_number() OVER (PARTITION BY package ORDER BY folder, path) <= 60)
 SELECT path, spec, target, CAST(NULL AS VARCHAR) AS lib FROM cls UNION ALL SELECT r.path, spec, target, NULL FROM rest r JOIN packs USING (package) WHERE wild
 UNION ALL SELECT DISTINCT r.path, spec, t.path, NULL FROM rest r JOIN ends USING (package) JOIN top t ON t.folder = ends.folder AND t.name = r.name WHERE NOT wild
 UNION ALL SELECT path, spec, NULL, array_to_string((CASE WHEN wild OR len(parts) < 2 THEN parts ELSE parts[1:len(parts) - 1] END)[1:2], '.') FROM rest WHERE package NOT IN (SELECT package FROM ends)""")
def jvm_targets(spark, sf_dir):
    """The file of an imported class, the files of a package, or those that define a name in it."""
    t = A.package_tables(spark, sf_dir)
    return packages.jvm_targets(t["jvm"], t["files"], t["defs"])


@query(_with(_EDGES) + """, me AS (SELECT key, file_key FROM nodes WHERE key = 's:7'), near AS (SELECT t AS key, CASE type WHEN 2 THEN 2 ELSE 0 END AS place, type = 1 AS weak FROM edges WHERE s = 's:7' UNION ALL SELECT s, 1, type = 1 FROM edges WHERE t = 's:7' AND type <> 2 UNION ALL SELECT t, 3, FALSE FROM edges, me WHERE s = file_key)
 SELECT name, key FROM near JOIN nodes USING (key) WHERE kind NOT IN ('file', 'dir') QUALIFY row_number() OVER (PARTITION BY name ORDER BY place, weak AND place < 2, key) = 1""")
def name_links(spark, sf_dir):
    """What the names in a symbol's code link to."""
    return packages.name_links(*_graph_once(spark, sf_dir), "s:7")
