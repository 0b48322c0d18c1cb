"""Query name to query, and query name to DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanglemap.extract.rows import edges_of, extract_sources, nodes_of
from tanglemap.functions import paths
from tanglemap.operators import audit, coupling, coverage, graph, history, incremental, search, search_index, snapshot
from tanglemap.plans.adapters import ctes, distinct_view, view
from tanglemap.scratch import cut, scratch_folder
from tanglemap.sources import gitlog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- change history -------------------------------------------------------------------

CHURN_SQL = "SELECT file_path, COUNT(DISTINCT commit_id) AS commits, CAST(SUM(added) AS BIGINT) AS lines_added, CAST(SUM(deleted) AS BIGINT) AS lines_deleted FROM history"


@query("churn", ctes("history") + CHURN_SQL + " GROUP BY file_path")
def _churn(spark, d):
    return history.churn(view(spark, d, "history"))


@query("churn_since", ctes("history") + CHURN_SQL + " WHERE ts >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY file_path")
def _churn_since(spark, d):
    return history.churn(view(spark, d, "history"), "1996-01-01 00:00:00")


@query(
    "churn_of_folders",
    ctes("history") + "SELECT LEFT(file_path, 2) AS name, COUNT(DISTINCT commit_id) AS commits FROM history WHERE ts >= TIMESTAMP '1995-03-15 00:00:00' AND ts < TIMESTAMP '1997-07-20 00:00:00' GROUP BY 1",
)
def _churn_of_folders(spark, d):
    """Files whose names begin alike are taken as a folder."""
    rows = view(spark, d, "history")
    numbers = cut(history.commit_numbers(rows))
    return history.commits_between(cut(history.commit_bitmaps(rows, numbers)), numbers, F.substring("file_path", 1, 2), "1995-03-15 00:00:00", "1997-07-20 00:00:00")


@query("topk_churn", ctes("history") + CHURN_SQL + " GROUP BY file_path ORDER BY commits DESC, file_path LIMIT 20")
def _topk_churn(spark, d):
    return history.churn(view(spark, d, "history")).orderBy(F.desc("commits"), "file_path").limit(20)


METRICS_SQL = """
 , ca AS (SELECT dst AS file_path, CAST(COUNT(*) AS DOUBLE) AS fan_in FROM supplier_edges GROUP BY dst),
 ce AS (SELECT src AS file_path, CAST(COUNT(*) AS DOUBLE) AS fan_out FROM supplier_edges GROUP BY src),
 metrics AS (SELECT f.file_path, COALESCE(fan_in, 0.0) AS fan_in, COALESCE(fan_out, 0.0) AS fan_out,
   CASE WHEN COALESCE(fan_in, 0.0) + COALESCE(fan_out, 0.0) > 0 THEN COALESCE(fan_out, 0.0) / (COALESCE(fan_in, 0.0) + COALESCE(fan_out, 0.0)) ELSE 0.0 END AS instability
   FROM supplier_files f LEFT JOIN ca ON ca.file_path = f.file_path LEFT JOIN ce ON ce.file_path = f.file_path)
"""
METRICS = ctes("supplier_files", "supplier_edges") + METRICS_SQL


def _metrics(spark, d):
    return coupling.module_metrics(view(spark, d, "supplier_files"), view(spark, d, "supplier_edges"))


def _supplier_churn(spark, d):
    rows = view(spark, d, "history").withColumn("file_path", F.concat(F.lit("supp/"), "author"))
    return history.churn(rows)


HOT_SQL = METRICS + """, history AS (SELECT 'supp/' || CAST(l_suppkey AS STRING) AS file_path, l_orderkey AS commit_id FROM lineitem),
 churned AS (SELECT file_path, COUNT(DISTINCT commit_id) AS churn FROM history GROUP BY file_path)
 SELECT metrics.file_path, churn, fan_in + fan_out AS coupling, churn * (fan_in + fan_out) AS hotspot_score FROM metrics JOIN churned ON metrics.file_path = churned.file_path"""


@query("hotspots", HOT_SQL)
def _hotspots(spark, d):
    return history.hotspots(_metrics(spark, d), _supplier_churn(spark, d))


@query("report_hotspots", f"SELECT * FROM ({HOT_SQL} ORDER BY hotspot_score DESC, file_path LIMIT 10) AS top WHERE hotspot_score > 0")
def _report_hotspots(spark, d):
    return history.hotspots(_metrics(spark, d), _supplier_churn(spark, d), 10).filter("hotspot_score > 0")


def _pairs_sql(source: str, shared: int, ratio: float) -> str:
    return ctes(source) + f""", files AS (SELECT DISTINCT commit_id, file_path FROM {source}), n AS (SELECT file_path, COUNT(*) AS n FROM files GROUP BY file_path),
 s AS (SELECT a.file_path AS file_a, b.file_path AS file_b, COUNT(*) AS shared_commits FROM files a JOIN files b ON a.commit_id = b.commit_id AND a.file_path < b.file_path GROUP BY a.file_path, b.file_path)
 SELECT file_a, file_b, shared_commits, ROUND(shared_commits / LEAST(x.n, y.n), 4) AS coupling_ratio FROM s JOIN n x ON x.file_path = file_a JOIN n y ON y.file_path = file_b
 WHERE shared_commits >= {shared} AND shared_commits / LEAST(x.n, y.n) >= {ratio}"""


@query("temporal_coupling", _pairs_sql("history_nation", 5, 0.15))
def _temporal(spark, d):
    return history.temporal_coupling(view(spark, d, "history_nation"), 5, 0.15)


@query("temporal_coupling_files", _pairs_sql("history", 2, 0.01))
def _temporal_files(spark, d):
    return history.temporal_coupling(view(spark, d, "history"), 2, 0.01)


def _bus_sql(source: str, coverage: float) -> str:
    return ctes(source) + f""", a AS (SELECT file_path, author, COUNT(*) AS lines, MIN(line_no) AS first_line FROM {source} GROUP BY file_path, author),
 r AS (SELECT *, ROW_NUMBER() OVER w AS rank, SUM(lines) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, SUM(lines) OVER (PARTITION BY file_path) AS total FROM a
       WINDOW w AS (PARTITION BY file_path ORDER BY lines DESC, first_line, author))
 SELECT file_path, MAX(CASE WHEN rank = 1 THEN author END) AS top_author, ROUND(100.0 * MAX(CASE WHEN rank = 1 THEN lines END) / MAX(total), 1) AS top_author_pct,
  CAST(MIN(CASE WHEN upto / total >= {coverage} THEN rank END) AS INT) AS bus_factor FROM r GROUP BY file_path"""


@query("bus_factor", _bus_sql("blame", 0.8))
def _bus(spark, d):
    return history.bus_factor(view(spark, d, "blame"))


SINGLE = 0.35  # share of lines that makes one of three authors the single one


@query("report_single_author", f"SELECT * FROM ({_bus_sql('supplier_blame', SINGLE)}) AS b WHERE bus_factor = 1")
def _single(spark, d):
    return history.bus_factor(view(spark, d, "supplier_blame"), SINGLE).filter("bus_factor = 1")


@query(
    "top_author",
    ctes("blame") + """, a AS (SELECT file_path, author, COUNT(*) AS lines, MIN(line_no) AS first_line FROM blame GROUP BY file_path, author)
 SELECT file_path, author AS top_author, lines FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_path ORDER BY lines DESC, first_line, author) AS r FROM a) AS x WHERE r = 1""",
)
def _top_author(spark, d):
    return history.top_author(view(spark, d, "blame"))


@query(
    "parse_numstat",
    """SELECT LPAD(CAST(l_orderkey AS STRING), 40, '0') AS commit_id, 'src/' || CAST(l_partkey AS STRING) || '.py' AS file_path,
 CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(FLOOR(l_quantity) AS BIGINT) END AS added, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_linenumber AS BIGINT) END AS deleted FROM lineitem""",
)
def _numstat(spark, d):
    return gitlog.parse_numstat(view(spark, d, "log_lines"))


@query("parse_blame", ctes("blame_lines") + "SELECT file_path, line_no, SUBSTR(line, 8) AS author FROM blame_lines WHERE STARTS_WITH(line, 'author ')")
def _parse_blame(spark, d):
    return gitlog.parse_blame(view(spark, d, "blame_lines"))


# --- structural coupling --------------------------------------------------------------


@query("module_metrics", METRICS + "SELECT * FROM metrics")
def _module_metrics(spark, d):
    return _metrics(spark, d)


@query("fan_in", ctes("supplier_edges") + "SELECT dst AS file_path, CAST(COUNT(*) AS DOUBLE) AS fan_in FROM supplier_edges GROUP BY dst")
def _fan_in(spark, d):
    return coupling.fan_in(view(spark, d, "supplier_edges"))


@query("fan_out", ctes("supplier_edges") + "SELECT src AS file_path, CAST(COUNT(*) AS DOUBLE) AS fan_out FROM supplier_edges GROUP BY src")
def _fan_out(spark, d):
    return coupling.fan_out(view(spark, d, "supplier_edges"))


GODS = METRICS + """, x AS (SELECT fan_in, ROW_NUMBER() OVER (ORDER BY fan_in) AS r, COUNT(*) OVER () AS n FROM metrics),
 p AS (SELECT MAX(n) AS n, LEAST(GREATEST((90 * (MAX(n) + 1)) // 100, 1), MAX(n) - 1) AS j FROM x),
 t AS (SELECT ((SELECT fan_in FROM x WHERE r = j) * (100 - (90 * (n + 1) - j * 100)) + (SELECT fan_in FROM x WHERE r = j + 1) * (90 * (n + 1) - j * 100)) / 100 AS threshold FROM p WHERE n > 1),
 gods AS (SELECT metrics.* FROM metrics, t WHERE fan_in > threshold) """


@query("god_modules", GODS + "SELECT file_path, fan_in, fan_out, instability FROM gods")
def _gods(spark, d):
    return coupling.god_modules(_metrics(spark, d))


def _kept_state(spark, d):
    """The metrics of an older graph (files that end in 9 are new since, those that end in 7 then
    imported one file alone) brought up to date by the changes of these files."""
    files, edges = view(spark, d, "supplier_files"), view(spark, d, "supplier_edges")
    is_new, is_stale = F.col("file_path").endswith("9"), F.col("src").endswith("7")
    before = edges.filter(~F.col("src").endswith("9")).withColumn("dst", F.when(is_stale, F.lit("supp/1")).otherwise(F.col("dst")))
    state = incremental.metric_state(files.filter(~is_new), before)
    changed = files.filter(is_new | F.col("file_path").endswith("7"))
    return incremental.apply_changes(state, incremental.edge_changes(before, edges, changed), added=files.filter(is_new))


@query("incremental_metrics", METRICS + "SELECT file_path, fan_in, fan_out, instability FROM metrics")
def _incremental_metrics(spark, d):
    return _kept_state(spark, d).metrics()


@query("incremental_gods", GODS + "SELECT file_path, fan_in, fan_out, instability FROM gods")
def _incremental_gods(spark, d):
    return incremental.god_modules(_kept_state(spark, d))


FLAGGED = GODS + "SELECT m.*, g.file_path IS NOT NULL AS is_god FROM metrics m LEFT JOIN gods g ON g.file_path = m.file_path"


@query("flagged_modules", FLAGGED + " WHERE g.file_path IS NOT NULL OR (m.fan_in > 0 AND m.instability >= 0.51)")
def _flagged(spark, d):
    return coupling.flagged_modules(_metrics(spark, d), 0.51)


@query("coupling_report", f"SELECT file_path, ROUND(fan_in, 2) AS fan_in, ROUND(fan_out, 2) AS fan_out, ROUND(instability, 3) AS instability, is_god FROM ({FLAGGED}) AS r")
def _coupling_report(spark, d):
    return coupling.flagged_modules(_metrics(spark, d), -1.0).select("file_path", F.round("fan_in", 2).alias("fan_in"), F.round("fan_out", 2).alias("fan_out"), F.round("instability", 3).alias("instability"), "is_god")


@query("topk_fan_in", METRICS + "SELECT * FROM metrics ORDER BY fan_in DESC, file_path LIMIT 20")
def _topk_fan_in(spark, d):
    return _metrics(spark, d).orderBy(F.desc("fan_in"), "file_path").limit(20)


MODULE = "REGEXP_REPLACE(REGEXP_REPLACE(REPLACE(path, '/', '.'), '\\.(py|js|ts|jsx|tsx)$', ''), '\\.__init__$', '')"


@query("module_map", ctes("paths") + f"SELECT {MODULE} AS module, MIN(path) AS file_path FROM paths GROUP BY 1")
def _module_map(spark, d):
    return coupling.module_map(view(spark, d, "paths").withColumnRenamed("path", "file_path"))


IMPORT_TARGET = """, named AS (SELECT id, path, """ + MODULE + """ AS module FROM paths),
 wanted AS (SELECT a.path AS src, CASE a.id % 4 WHEN 0 THEN b.path WHEN 1 THEN b.module WHEN 2 THEN '.' || REGEXP_EXTRACT(b.module, '[^.]*$') ELSE REGEXP_EXTRACT(b.module, '[^.]*$') END AS dst
            FROM named a JOIN named b ON b.id = a.id + 150) """


@query(
    "resolve_imports",
    ctes("paths") + IMPORT_TARGET + """, m AS (SELECT module, MIN(path) AS file_path FROM named GROUP BY module),
 e AS (SELECT src, dst, REPLACE(REGEXP_EXTRACT(src, '^(.*)/[^/]*$', 1), '/', '.') AS package FROM wanted)
 SELECT src, dst, COALESCE((SELECT MIN(path) FROM named WHERE path = dst), (SELECT MIN(file_path) FROM m WHERE module = dst),
  CASE WHEN dst LIKE '.%' THEN (SELECT MIN(file_path) FROM m WHERE module = package || dst) END,
  CASE WHEN INSTR(dst, '.') = 0 THEN (SELECT MIN(file_path) FROM m WHERE module = package || '.' || dst) END) AS resolved FROM e""",
)
def _resolve_imports(spark, d):
    named = view(spark, d, "paths").select("id", "path", paths.module_name(F.col("path")).alias("module"))
    last = F.element_at(F.split("b.module", r"\."), -1)
    target = F.when(F.col("a.id") % 4 == 0, F.col("b.path")).when(F.col("a.id") % 4 == 1, F.col("b.module")).when(F.col("a.id") % 4 == 2, F.concat(F.lit("."), last)).otherwise(last)
    edges = named.alias("a").join(named.alias("b"), F.col("b.id") == F.col("a.id") + 150).select(F.col("a.path").alias("src"), target.alias("dst"))
    return coupling.resolve_imports(edges, named.select(F.col("path").alias("file_path")))


@query("class_children", ctes("customer_classes", "customer_tree") + "SELECT qualified_name, COUNT(dst) AS children FROM customer_classes LEFT JOIN customer_tree ON dst = qualified_name GROUP BY qualified_name")
def _children(spark, d):
    return coupling.class_children(view(spark, d, "customer_classes"), view(spark, d, "customer_tree"))


@query(
    "inheritance_metrics",
    ctes("customer_classes", "customer_tree", recursive=True) + """, walk AS (SELECT src AS name, dst AS top, 1 AS depth FROM customer_tree UNION ALL SELECT name, dst, depth + 1 FROM walk JOIN customer_tree ON src = top),
 k AS (SELECT dst, COUNT(*) AS children FROM customer_tree GROUP BY dst)
 SELECT qualified_name, CAST(COALESCE((SELECT MAX(depth) FROM walk WHERE name = qualified_name), 0) AS INT) AS depth, COALESCE(children, 0) AS children FROM customer_classes LEFT JOIN k ON k.dst = qualified_name""",
)
def _inheritance(spark, d):
    return coupling.inheritance_metrics(view(spark, d, "customer_classes"), view(spark, d, "customer_tree"))


@query("inheritance_chain", ctes("customer_chain") + """, k AS (SELECT dst, COUNT(*) AS children FROM customer_chain GROUP BY dst)
 SELECT 'c' || CAST(c_custkey AS STRING) AS qualified_name, CAST(c_custkey % 200 AS INT) AS depth, COALESCE(children, 0) AS children FROM customer LEFT JOIN k ON k.dst = 'c' || CAST(c_custkey AS STRING)""")
def _inheritance_chain(spark, d):
    return coupling.inheritance_metrics(view(spark, d, "customer_classes"), view(spark, d, "customer_chain"))


@query("inheritance_cycle", ctes("customer_cycle") + """, k AS (SELECT dst, COUNT(*) AS children FROM customer_cycle GROUP BY dst), m AS (SELECT MAX(c_custkey) AS last FROM customer)
 SELECT 'c' || CAST(c_custkey AS STRING) AS qualified_name, CAST(CASE WHEN c_custkey - c_custkey % 100 + 99 <= last THEN 100 ELSE last - c_custkey + 1 END AS INT) AS depth, COALESCE(children, 0) AS children
 FROM m, customer LEFT JOIN k ON k.dst = 'c' || CAST(c_custkey AS STRING)""")
def _inheritance_cycle(spark, d):
    return coupling.inheritance_metrics(view(spark, d, "customer_classes"), view(spark, d, "customer_cycle"))


# --- graph ----------------------------------------------------------------------------

SCC_SQL = """, reach AS (SELECT src, dst FROM {e} UNION SELECT r.src, e.dst FROM reach r JOIN {e} e ON e.src = r.dst),
 mutual AS (SELECT a.src AS node, MIN(b.src) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
 SELECT LEAST(MIN(component), MIN(node)) AS component, LIST_SORT(LIST(node)) AS members FROM mutual GROUP BY mutual.component HAVING COUNT(*) > 1"""


@query("scc_cycles", ctes("event_edges", recursive=True) + SCC_SQL.format(e="event_edges"))
def _scc(spark, d):
    return graph.scc_cycles(view(spark, d, "event_edges"))


@query("scc_cycles_nations", ctes("nation_edges", recursive=True) + SCC_SQL.format(e="nation_edges"))
def _scc_nations(spark, d):
    return graph.scc_cycles(view(spark, d, "nation_edges"))


@query(
    "impact_radius",
    ctes("nation_edges") + """, u AS (SELECT src, dst FROM nation_edges UNION SELECT dst, src FROM nation_edges),
 one AS (SELECT dst AS node FROM u WHERE src = 0), two AS (SELECT dst AS node FROM u WHERE src IN (SELECT node FROM one)),
 met AS (SELECT 0 AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two)
 SELECT CAST(node AS INT) AS node, CAST(MIN(depth) AS INT) AS depth, CASE WHEN MIN(depth) = 0 THEN 'seed' ELSE 'impacted' END AS role FROM met GROUP BY node""",
)
def _impact(spark, d):
    edges = view(spark, d, "nation_edges")
    seeds = view(spark, d, "nation").filter("n_nationkey = 0").select(F.col("n_nationkey").alias("node"))
    return graph.impact_radius(edges, seeds)


@query(
    "impact_radius_events",
    ctes("event_edges") + """, u AS (SELECT src, dst FROM event_edges UNION SELECT dst, src FROM event_edges),
 seed AS (SELECT DISTINCT src AS node FROM u WHERE src LIKE '%/click'), one AS (SELECT dst AS node FROM u WHERE src IN (SELECT node FROM seed)), two AS (SELECT dst AS node FROM u WHERE src IN (SELECT node FROM one)),
 met AS (SELECT node, 0 AS depth FROM seed UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two)
 SELECT node, CAST(MIN(depth) AS INT) AS depth, CASE WHEN MIN(depth) = 0 THEN 'seed' ELSE 'impacted' END AS role FROM met GROUP BY node""",
)
def _impact_events(spark, d):
    edges = view(spark, d, "event_edges")
    seeds = edges.select(F.col("src").alias("node")).union(edges.select("dst")).filter("node like '%/click'")
    return graph.impact_radius(edges, seeds, max_nodes=1 << 60)


@query(
    "dependency_chain",
    ctes("nation_edges", recursive=True) + """, e AS (SELECT DISTINCT src, dst FROM nation_edges), root AS (SELECT MIN(src) AS node FROM e),
 walk AS (SELECT node, 0 AS depth, [node] AS chain FROM root UNION ALL SELECT e.dst, depth + 1, LIST_APPEND(chain, e.dst) FROM walk JOIN e ON e.src = walk.node WHERE depth < 3 AND NOT LIST_CONTAINS(chain, e.dst))
 SELECT node, CAST(MIN(depth) AS INT) AS depth, MIN(chain) AS chain FROM (SELECT *, MIN(depth) OVER (PARTITION BY node) AS least FROM walk) AS w WHERE depth = least AND depth > 0 GROUP BY node""",
)
def _chain(spark, d):
    edges = view(spark, d, "nation_edges")
    root = edges.agg(F.min("src")).first()[0]
    return graph.dependency_chain(edges, root, 3)


@query("induced_edges", ctes("event_edges") + "SELECT src, dst FROM event_edges WHERE src LIKE '1%' AND dst LIKE '1%'")
def _induced(spark, d):
    edges = view(spark, d, "event_edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).filter("node like '1%'")
    return graph.induced_edges(edges, nodes)


@query("callers_of", ctes("calls", "symbols") + "SELECT qualified_name, name, file_path, line FROM calls JOIN symbols ON src = qualified_name WHERE dst = '7'")
def _callers(spark, d):
    return graph.callers_of(view(spark, d, "calls"), view(spark, d, "symbols"), "7")


@query("callees_of", ctes("calls", "symbols") + "SELECT qualified_name, name, file_path, line FROM calls JOIN symbols ON dst = qualified_name WHERE src = '7'")
def _callees(spark, d):
    return graph.callees_of(view(spark, d, "calls"), view(spark, d, "symbols"), "7")


@query("outgoing_edges", ctes("supplier_edges") + "SELECT * FROM supplier_edges WHERE src = 'supp/1' AND kind = 'USES_TYPE'")
def _outgoing(spark, d):
    return graph.outgoing(view(spark, d, "supplier_edges"), "supp/1", "USES_TYPE")


@query("incoming_edges", ctes("supplier_edges") + "SELECT * FROM supplier_edges WHERE dst = 'supp/1'")
def _incoming(spark, d):
    return graph.incoming(view(spark, d, "supplier_edges"), "supp/1")


@query("stats_nodes_by_kind", ctes("symbols") + "SELECT kind, COUNT(*) AS n FROM symbols GROUP BY kind")
def _nodes_by_kind(spark, d):
    return graph.kind_counts(view(spark, d, "symbols"))


@query("stats_edges_by_kind", ctes("supplier_edges") + "SELECT kind, COUNT(*) AS n FROM supplier_edges GROUP BY kind")
def _edges_by_kind(spark, d):
    return graph.kind_counts(view(spark, d, "supplier_edges"))


@query("graph_stats", ctes("symbols", "calls") + "SELECT COUNT(*) AS nodes, COUNT(DISTINCT file_path) AS files, COUNT(DISTINCT kind) AS kinds, (SELECT COUNT(*) FROM calls) AS edges FROM symbols")
def _stats(spark, d):
    return graph.graph_stats(view(spark, d, "symbols"), view(spark, d, "calls"))


# --- nodes and predicates -------------------------------------------------------------


@query("point_lookup", ctes("symbols") + "SELECT * FROM symbols WHERE qualified_name = '42'")
def _point(spark, d):
    return view(spark, d, "symbols").filter("qualified_name = '42'")


@query("nodes_by_file", ctes("symbols") + "SELECT * FROM symbols WHERE file_path = 'src/7.py' ORDER BY line_start, qualified_name")
def _by_file(spark, d):
    return view(spark, d, "symbols").filter("file_path = 'src/7.py'").orderBy("line_start", "qualified_name")


@query("distinct_files", ctes("symbols") + "SELECT DISTINCT file_path FROM symbols ORDER BY file_path")
def _files(spark, d):
    return view(spark, d, "symbols").select("file_path").distinct().orderBy("file_path")


@query("file_summary", ctes("symbols") + "SELECT file_path, COUNT(*) AS symbols, LIST_SORT(LIST(qualified_name)) AS names FROM symbols GROUP BY file_path")
def _summary(spark, d):
    return view(spark, d, "symbols").groupBy("file_path").agg(F.count("*").alias("symbols"), F.array_sort(F.collect_list("qualified_name")).alias("names"))


@query("search_imports", ctes("imports") + "SELECT * FROM imports WHERE dst ILIKE '%EXAMPLE.ORG%' ORDER BY file_path")
def _imports(spark, d):
    return view(spark, d, "imports").filter(F.col("dst").ilike("%EXAMPLE.ORG%")).orderBy("file_path")


@query("is_test_file", ctes("paths") + "SELECT path, REGEXP_MATCHES(path, '(^|/)test_[^/]*$') OR REGEXP_MATCHES(path, '(_test\\.py|\\.(test|spec)\\.(ts|js))$') AS is_test FROM paths")
def _test_file(spark, d):
    return view(spark, d, "paths").select("path", paths.is_test_file(F.col("path")).alias("is_test"))


@query("is_test_path", ctes("paths") + "SELECT path, " + " OR ".join(f"LOWER(path) LIKE '{p}'" for p in paths.TEST_PATTERNS) + " AS is_test FROM paths")
def _test_path(spark, d):
    return view(spark, d, "paths").select("path", paths.is_test_path(F.col("path")).alias("is_test"))


@query("language_of", ctes("paths") + "SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript' END AS language FROM paths")
def _language(spark, d):
    return view(spark, d, "paths").select("path", paths.language_of(F.col("path")).alias("language"))


@query("path_tokens", ctes("paths") + f"SELECT path, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(path, '[/._]'), lambda t: t <> '' AND t NOT IN ({', '.join(repr(w) for w in paths.PATH_SKIP)})) AS tokens FROM paths")
def _tokens(spark, d):
    return view(spark, d, "paths").select("path", paths.path_tokens(F.col("path")).alias("tokens"))


@query("ignore_filter", ctes("paths") + "SELECT path FROM paths WHERE NOT (path LIKE '%.md' OR REGEXP_MATCHES(path, '(^|/)promo[^/]*/') OR REGEXP_MATCHES(path, '(^|/)test_[^/]*\\.py$'))")
def _ignore(spark, d):
    return view(spark, d, "paths").filter(~paths.ignored(F.col("path"), ["*.md", "promo*", "test_*.py", "# note"])).select("path")


@query("content_hash", "SELECT doc_id, SHA256(text) AS hash FROM documents")
def _hash(spark, d):
    return view(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("json_flag_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def _json(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return view(spark, d, "flags").select("event_id", k.alias("k")).filter("k % 2 = 0")


@query("like_search", ctes("symbols") + "SELECT * FROM symbols WHERE LOWER(name) LIKE '%ring%' AND LOWER(name) LIKE '%econ%' ORDER BY qualified_name LIMIT 20")
def _like(spark, d):
    return search.like_search(view(spark, d, "symbols"), "RING Econ")


# --- coverage -------------------------------------------------------------------------

TESTS = "(" + " OR ".join(f"LOWER(file_path) LIKE '{p}'" for p in paths.TEST_PATTERNS) + ")"


@query("derive_covers", ctes("open_calls", "symbols") + f"SELECT qualified_name AS dst, COUNT(*) AS tests FROM open_calls JOIN symbols ON name = dst WHERE kind IN ('Function','Method') AND NOT {TESTS} GROUP BY qualified_name")
def _covers(spark, d):
    return coverage.cover_counts(view(spark, d, "open_calls"), view(spark, d, "symbols"))


@query("cover_edges", ctes("test_calls", "symbols") + f"SELECT src, qualified_name AS dst, test_calls.file_path, line FROM test_calls JOIN symbols ON name = dst WHERE kind IN ('Function','Method') AND NOT {TESTS.replace('file_path', 'symbols.file_path')}")
def _cover_edges(spark, d):
    return coverage.derive_covers(distinct_view(spark, d, "test_calls", "lineitem", "l_orderkey"), view(spark, d, "symbols"))


@query("uncovered_symbols", ctes("covers", "symbols") + f"SELECT qualified_name, name, file_path FROM symbols WHERE kind IN ('Function','Method') AND NOT {TESTS} AND qualified_name NOT IN (SELECT dst FROM covers)")
def _uncovered(spark, d):
    return coverage.uncovered_symbols(view(spark, d, "symbols"), view(spark, d, "covers")).select("qualified_name", "name", "file_path")


@query("uncovered_in_folder", ctes("covers", "symbols") + f"SELECT qualified_name, file_path FROM symbols WHERE kind IN ('Function','Method') AND NOT {TESTS} AND file_path LIKE 'src/1%' AND qualified_name NOT IN (SELECT dst FROM covers)")
def _uncovered_in_folder(spark, d):
    return coverage.uncovered_symbols(view(spark, d, "symbols"), view(spark, d, "covers"), prefix="src/1").select("qualified_name", "file_path")


@query("test_callers", ctes("calls", "symbols") + f"SELECT DISTINCT file_path FROM calls JOIN symbols ON src = qualified_name WHERE {TESTS} AND dst IN (SELECT qualified_name FROM symbols WHERE kind = 'Class')")
def _test_callers(spark, d):
    symbols = view(spark, d, "symbols")
    return coverage.test_callers(view(spark, d, "calls"), symbols, symbols.filter("kind = 'Class'"))


@query("symbol_index", ctes("symbols") + "SELECT file_path, name, COUNT(*) AS n, CASE WHEN COUNT(*) = 1 THEN MIN(qualified_name) END AS qualified_name FROM symbols GROUP BY file_path, name")
def _index(spark, d):
    return coverage.symbol_index(view(spark, d, "symbols"))


@query(
    "resolve_calls",
    ctes("symbols") + """, s AS (SELECT *, CASE WHEN kind = 'Method' THEN 'C' || CAST(line_start % 3 AS STRING) END AS parent_name FROM symbols),
 c AS (SELECT a.file_path, a.qualified_name AS caller, b.name AS callee, a.parent_name AS class_name FROM s a JOIN s b ON CAST(b.qualified_name AS BIGINT) = CAST(a.qualified_name AS BIGINT) + 50)
 SELECT * FROM (SELECT file_path, caller, callee, COALESCE((SELECT MIN(qualified_name) FROM s WHERE s.kind = 'Method' AND s.file_path = c.file_path AND s.parent_name = c.class_name AND s.name = c.callee),
   (SELECT CASE WHEN COUNT(*) = 1 THEN MIN(qualified_name) END FROM s WHERE s.file_path = c.file_path AND s.name = c.callee)) AS target FROM c) AS r WHERE target IS NULL OR target <> caller""",
)
def _resolve_calls(spark, d):
    s = view(spark, d, "symbols").withColumn("parent_name", F.when(F.col("kind") == "Method", F.concat(F.lit("C"), (F.col("line_start") % 3).cast("string"))))
    a, b = s.alias("a"), s.alias("b")
    calls = a.join(b, F.col("b.qualified_name").cast("long") == F.col("a.qualified_name").cast("long") + 50).select("a.file_path", F.col("a.qualified_name").alias("caller"), F.col("b.name").alias("callee"), F.col("a.parent_name").alias("class_name"))
    return coverage.resolve_calls(calls, s)


@query("uses_type_dedup", "SELECT CAST(l_suppkey AS STRING) AS file_path, CAST(l_partkey AS STRING) AS dst, MIN(l_orderkey) AS line FROM lineitem GROUP BY l_suppkey, l_partkey")
def _uses(spark, d):
    uses = view(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("file_path"), F.col("l_partkey").cast("string").alias("dst"), F.col("l_orderkey").alias("line"))
    return coverage.uses_type_once(uses)


# --- snapshots ------------------------------------------------------------------------


@query(
    "incremental_diff",
    ctes("stored_files", "current_files") + """SELECT COALESCE(s.file_path, c.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'removed' WHEN s.file_hash = c.file_hash THEN 'unchanged' ELSE 'changed' END AS status
 FROM stored_files s FULL JOIN current_files c ON s.file_path = c.file_path""",
)
def _incremental(spark, d):
    return snapshot.incremental_diff(view(spark, d, "stored_files"), view(spark, d, "current_files"))


@query("upsert_nodes", ctes("stored_files", "current_files") + "SELECT * FROM current_files UNION ALL SELECT * FROM stored_files WHERE file_path NOT IN (SELECT file_path FROM current_files)")
def _upsert(spark, d):
    return snapshot.upsert(view(spark, d, "stored_files"), view(spark, d, "current_files"), ["file_path"]).select("file_path", "file_hash")


@query("remove_files", ctes("stored_files", "current_files") + "SELECT * FROM stored_files WHERE file_path NOT IN (SELECT file_path FROM current_files)")
def _remove(spark, d):
    return snapshot.remove_files(view(spark, d, "stored_files"), view(spark, d, "current_files"))


@query("latest_by_key", "SELECT CAST(user_id AS STRING) AS key, event_id AS version, event_type AS value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) AS e WHERE r = 1")
def _latest(spark, d):
    rows = view(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("value"))
    return snapshot.latest_by(rows, ["key"], ["version"])


@query("metadata_upsert", "SELECT event_type AS key, CAST(MAX(event_id) AS STRING) AS value FROM events GROUP BY event_type")
def _metadata(spark, d):
    rows = view(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("version"))
    return snapshot.latest_by(rows, ["key"], ["version"]).select("key", F.col("version").cast("string").alias("value"))


BEFORE = METRICS + """, old_edges AS (""" + ctes("old_edges")[len("WITH old_edges AS ("):-1] + """),
 oca AS (SELECT dst AS file_path, CAST(COUNT(*) AS DOUBLE) AS fan_in FROM old_edges GROUP BY dst), oce AS (SELECT src AS file_path, CAST(COUNT(*) AS DOUBLE) AS fan_out FROM old_edges GROUP BY src),
 before AS (SELECT f.file_path, COALESCE(fan_in, 0.0) AS fan_in, COALESCE(fan_out, 0.0) AS fan_out,
   CASE WHEN COALESCE(fan_in, 0.0) + COALESCE(fan_out, 0.0) > 0 THEN COALESCE(fan_out, 0.0) / (COALESCE(fan_in, 0.0) + COALESCE(fan_out, 0.0)) ELSE 0.0 END AS instability
   FROM supplier_files f LEFT JOIN oca ON oca.file_path = f.file_path LEFT JOIN oce ON oce.file_path = f.file_path) """


def _before(spark, d):
    return coupling.module_metrics(view(spark, d, "supplier_files"), view(spark, d, "old_edges"))


@query("baseline_regressions", BEFORE + "SELECT m.file_path, 'instability' AS metric, ROUND(b.instability, 4) AS before, ROUND(m.instability, 4) AS after FROM metrics m JOIN before b ON b.file_path = m.file_path WHERE m.instability > ROUND(b.instability, 4) + 0.01")
def _regressions(spark, d):
    return snapshot.instability_regressions(_before(spark, d), _metrics(spark, d), 0.01)


@query("graph_diff", BEFORE + "SELECT m.file_path, m.fan_in - b.fan_in AS d_fan_in, m.fan_out - b.fan_out AS d_fan_out, m.instability - b.instability AS d_instability FROM metrics m JOIN before b ON b.file_path = m.file_path")
def _delta(spark, d):
    return snapshot.metric_delta(_before(spark, d), _metrics(spark, d))


@query("baseline_snapshot", METRICS + "SELECT file_path, ROUND(fan_in, 3) AS fan_in, ROUND(fan_out, 3) AS fan_out, ROUND(instability, 4) AS instability FROM metrics")
def _baseline(spark, d):
    return _metrics(spark, d).select("file_path", F.round("fan_in", 3).alias("fan_in"), F.round("fan_out", 3).alias("fan_out"), F.round("instability", 4).alias("instability"))


def _gods_sql(source: str, name: str) -> str:
    return f"""{name}_x AS (SELECT file_path, fan_in, ROW_NUMBER() OVER (ORDER BY fan_in) AS r, COUNT(*) OVER () AS n FROM {source}),
 {name}_p AS (SELECT MAX(n) AS n, LEAST(GREATEST((90 * (MAX(n) + 1)) // 100, 1), MAX(n) - 1) AS j FROM {name}_x),
 {name}_t AS (SELECT ((SELECT fan_in FROM {name}_x WHERE r = j) * (100 - (90 * (n + 1) - j * 100)) + (SELECT fan_in FROM {name}_x WHERE r = j + 1) * (90 * (n + 1) - j * 100)) / 100 AS threshold FROM {name}_p WHERE n > 1),
 {name} AS (SELECT file_path FROM {source}, {name}_t WHERE fan_in > threshold)"""


@query("baseline_new_gods", BEFORE + ", " + _gods_sql("before", "old_gods") + ", " + _gods_sql("metrics", "new_gods") + " SELECT file_path FROM new_gods WHERE file_path NOT IN (SELECT file_path FROM old_gods)")
def _new_gods(spark, d):
    return snapshot.new_rows(coupling.god_modules(_before(spark, d)), coupling.god_modules(_metrics(spark, d)), "file_path")


EARLY = ", early AS (SELECT src, dst FROM event_edges WHERE src NOT LIKE '%7/%')"


@query(
    "baseline_new_cycles",
    ctes("event_edges", recursive=True) + EARLY + "".join(
        f""", {r} AS (SELECT src, dst FROM {e} UNION SELECT {r}.src, {e}.dst FROM {r} JOIN {e} ON {e}.src = {r}.dst),
 {r}_m AS (SELECT a.src AS node, MIN(b.src) AS component FROM {r} a JOIN {r} b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
 {r}_c AS (SELECT LIST_SORT(LIST(node)) AS members FROM {r}_m GROUP BY component HAVING COUNT(*) > 1)"""
        for r, e in (("old_reach", "early"), ("new_reach", "event_edges"))
    ) + " SELECT members FROM new_reach_c WHERE members NOT IN (SELECT members FROM old_reach_c)",
)
def _new_cycles(spark, d):
    edges = view(spark, d, "event_edges")
    return snapshot.new_rows(graph.scc_cycles(edges.filter("src not like '%7/%'")), graph.scc_cycles(edges), "members")


@query(
    "full_report",
    METRICS + """, c AS (SELECT 'supp/' || CAST(l_suppkey AS STRING) AS file_path, COUNT(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY l_suppkey)
 SELECT metrics.file_path, fan_in, fan_out, ROUND(instability, 3) AS instability, commits, commits * (fan_in + fan_out) AS hotspot_score FROM metrics LEFT JOIN c ON c.file_path = metrics.file_path""",
)
def _full_report(spark, d):
    hot = history.hotspots(_metrics(spark, d), _supplier_churn(spark, d)).select("file_path", F.col("churn").alias("commits"), "hotspot_score")
    return _metrics(spark, d).join(hot, "file_path", "left").select("file_path", "fan_in", "fan_out", F.round("instability", 3).alias("instability"), "commits", "hotspot_score")


# --- search ---------------------------------------------------------------------------


LOOSE = "(" + " OR ".join(f"LOWER(file_path) LIKE '{p}'" for p in search.LOOSE_TEST_PATTERNS) + ")"
SKIPPED = ", ".join(f"'{w}'" for w in paths.PATH_SKIP)


@query(
    "rich_node_text",
    ctes("rich_nodes", "rich_imports", "calls") + f""", tops AS (SELECT file_path, STRING_AGG(name, ' ' ORDER BY name, qualified_name) AS tops FROM rich_nodes WHERE kind <> 'File' AND parent_name IS NULL GROUP BY file_path),
 methods AS (SELECT file_path, parent_name, STRING_AGG(name, ' ' ORDER BY name, qualified_name) AS methods FROM rich_nodes WHERE kind = 'Method' GROUP BY file_path, parent_name),
 brought AS (SELECT file_path, STRING_AGG(part, ' ' ORDER BY part) AS brought FROM (SELECT file_path, REGEXP_EXTRACT(dst, '[^.]*$') AS part FROM rich_imports) AS i GROUP BY file_path),
 tests AS (SELECT DISTINCT callee.file_path, t.test_file FROM calls JOIN (SELECT qualified_name, file_path AS test_file FROM rich_nodes WHERE {LOOSE}) AS t ON src = t.qualified_name JOIN rich_nodes callee ON dst = callee.qualified_name),
 stems AS (SELECT file_path, STRING_AGG(REGEXP_EXTRACT(test_file, '([^/.]+)[.][^./]*$', 1), ' ' ORDER BY test_file) AS stems FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_path ORDER BY test_file) AS r FROM tests) AS t WHERE r <= 5 GROUP BY file_path)
 SELECT qualified_name, CONCAT_WS(' ', kind, name, 'path ' || ARRAY_TO_STRING(LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(n.file_path, '[/._]'), lambda t: t <> '' AND t NOT IN ({SKIPPED})), ' '), signature, docstring,
   'imports ' || brought, CASE kind WHEN 'File' THEN tops WHEN 'Class' THEN methods END, 'tested by ' || stems) AS text
 FROM rich_nodes n LEFT JOIN tops ON tops.file_path = n.file_path LEFT JOIN methods ON methods.file_path = n.file_path AND methods.parent_name = n.name LEFT JOIN brought ON brought.file_path = n.file_path LEFT JOIN stems ON stems.file_path = n.file_path""",
)
def _rich(spark, d):
    return search.rich_text(view(spark, d, "rich_nodes"), view(spark, d, "rich_imports"), view(spark, d, "calls")).select("qualified_name", "text")


@query(
    "file_summary_symbols",
    ctes("rich_nodes", "rich_imports") + """, s AS (SELECT file_path, LIST_SORT(LIST(kind || ':' || name || ':' || CAST(line_start AS VARCHAR) || ':' || COALESCE(parent_name, '')) FILTER (WHERE kind <> 'File')) AS symbols FROM rich_nodes GROUP BY file_path),
 e AS (SELECT file_path, LIST_SORT(LIST(dst)) AS targets FROM rich_imports GROUP BY file_path), w AS (SELECT DISTINCT file_path FROM rich_nodes UNION SELECT 'src/none.py')
 SELECT w.file_path, symbols, CASE WHEN symbols IS NOT NULL THEN COALESCE(targets, []) END AS targets FROM w LEFT JOIN s ON s.file_path = w.file_path LEFT JOIN e ON e.file_path = w.file_path""",
)
def _summary_symbols(spark, d):
    nodes = view(spark, d, "rich_nodes")
    wanted = nodes.select("file_path").union(spark.createDataFrame([("src/none.py",)], "file_path string"))
    told = search.file_summary(nodes, view(spark, d, "rich_imports"), wanted)
    symbol = lambda n: F.concat_ws(":", n["kind"], n["name"], n["line_start"].cast("string"), F.coalesce(n["parent"], F.lit("")))
    return told.select("file_path", F.array_sort(F.transform("nodes", symbol)).alias("symbols"), F.array_sort(F.transform("edges", lambda e: e["target"])).alias("targets"))


@query("index_stats", ctes("rich_nodes", "rich_imports") + "SELECT COUNT(*) FILTER (WHERE kind = 'File') AS files, COUNT(*) AS total_nodes, LIST_SORT(LIST(DISTINCT language)) AS languages, (SELECT COUNT(*) FROM rich_imports) AS total_edges, (SELECT COUNT(*) FROM embeddings) AS embeddings FROM rich_nodes")
def _index_stats(spark, d):
    return graph.index_stats(view(spark, d, "rich_nodes"), view(spark, d, "rich_imports"), view(spark, d, "embeddings"))


@query("test_callers_loose", ctes("calls", "rich_nodes") + f"SELECT DISTINCT file_path FROM calls JOIN rich_nodes ON src = qualified_name WHERE {LOOSE} AND dst IN (SELECT qualified_name FROM rich_nodes WHERE file_path = 'src/7.py') ORDER BY file_path LIMIT 5")
def _test_callers_loose(spark, d):
    nodes = view(spark, d, "rich_nodes")
    return coverage.test_callers(view(spark, d, "calls"), nodes, nodes.filter("file_path = 'src/7.py'"), search.LOOSE_TEST_PATTERNS, 5)


@query(
    "symbol_index_parents",
    ctes("rich_nodes") + """, n AS (SELECT file_path, name, qualified_name FROM rich_nodes UNION ALL SELECT file_path, parent_name || '.' || name, qualified_name FROM rich_nodes WHERE parent_name IS NOT NULL)
 SELECT file_path, name, COUNT(*) AS n, CASE WHEN COUNT(*) = 1 THEN MIN(qualified_name) END AS qualified_name FROM n GROUP BY file_path, name""",
)
def _index_parents(spark, d):
    return coverage.symbol_index(view(spark, d, "rich_nodes"))


@query(
    "impact_of_files",
    ctes("rich_nodes", "calls") + """, u AS (SELECT DISTINCT src, dst FROM calls WHERE src <> dst UNION SELECT DISTINCT dst, src FROM calls WHERE src <> dst), seed AS (SELECT qualified_name AS node FROM rich_nodes WHERE file_path = 'src/7.py'),
 one AS (SELECT DISTINCT dst AS node FROM u WHERE src IN (SELECT node FROM seed)),
 impacted AS (SELECT n.* FROM rich_nodes n WHERE qualified_name IN (SELECT node FROM one) AND qualified_name NOT IN (SELECT node FROM seed))
 SELECT qualified_name, file_path FROM impacted""",
)
def _impact_of_files(spark, d):
    wanted = spark.createDataFrame([("src/7.py",)], "file_path string")
    return graph.impact_of_files(view(spark, d, "rich_nodes"), view(spark, d, "calls"), wanted, 1).impacted.select("qualified_name", "file_path")


@query("fts_tokenize", "SELECT doc_id AS node_id, LEN(LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(LOWER(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS n_tokens FROM documents")
def _tokenize(spark, d):
    return view(spark, d, "docs").select("node_id", F.size(search.tokens(F.col("body"))).cast("long").alias("n_tokens"))


@query("fts_normalize", "SELECT p_partkey AS id, LOWER(TRIM(REGEXP_REPLACE(REGEXP_REPLACE(p_brand || p_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^\\w]+', ' ', 'g') || ' ' || REGEXP_REPLACE(p_brand || p_name, '[^\\w]+', ' ', 'g'))) AS text FROM part")
def _normalize(spark, d):
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), search.normalised(F.concat("p_brand", "p_name")).alias("text"))


BM25_SQL = """WITH t AS (SELECT doc_id AS node_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(STRIP_ACCENTS(LOWER(source || ' ' || source || ' ' || text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents),
 f AS (SELECT node_id, LEN(w) AS d, LEN(LIST_FILTER(w, lambda x: STARTS_WITH(x, 'license'))) AS a, LEN(LIST_FILTER(w, lambda x: STARTS_WITH(x, 'the'))) AS b FROM t),
 s AS (SELECT COUNT(*) AS n, AVG(d) AS m, COUNT(*) FILTER (WHERE a > 0) AS na, COUNT(*) FILTER (WHERE b > 0) AS nb FROM f)
 SELECT node_id, ROUND(-2 * (GREATEST(LN((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * d / m)) + GREATEST(LN((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * d / m))), 6) AS score
 FROM f, s WHERE a > 0 AND b > 0"""


@query("bm25_search", BM25_SQL)
def _bm25(spark, d):
    return search.bm25_search(view(spark, d, "docs"), "license the", None).select("node_id", F.round("score", 6).alias("score"))


@query("topk_bm25", f"SELECT * FROM ({BM25_SQL}) AS found ORDER BY score, node_id LIMIT 20")
def _topk_bm25(spark, d):
    found = search.bm25_search(view(spark, d, "docs"), "license the", None).select("node_id", F.round("score", 6).alias("score"))
    return found.orderBy("score", "node_id").limit(20)


def _indexed_docs(spark, d):
    return view(spark, d, "docs").withColumn("file_path", F.col("name"))


@query("bm25_indexed", BM25_SQL)
def _bm25_indexed(spark, d):
    index = search_index.store_index(search_index.build_index(_indexed_docs(spark, d)), scratch_folder(spark, "search-index"))
    return search_index.search_index(index, "license the", None).select("node_id", F.round("score", 6).alias("score"))


@query("topk_bm25_indexed", f"SELECT * FROM ({BM25_SQL}) AS found ORDER BY score, node_id LIMIT 20")
def _topk_bm25_indexed(spark, d):
    index = search_index.store_index(search_index.build_index(_indexed_docs(spark, d)), scratch_folder(spark, "search-index"))
    found = search_index.search_index(index, "license the", 40).select("node_id", F.round("score", 6).alias("score"))
    return found.orderBy("score", "node_id").limit(20)  # equal as rounded, so with some to spare


@query("bm25_index_update", BM25_SQL)
def _bm25_index_update(spark, d):
    """Every other source, by the length of its name, was indexed with an older text."""
    docs = _indexed_docs(spark, d)
    stale = F.length("file_path") % 2 == 0
    before = docs.withColumn("body", F.when(stale, F.concat(F.lit("license "), F.substring("body", 1, 40))).otherwise(F.col("body")))
    index = search_index.store_index(search_index.build_index(before), scratch_folder(spark, "search-index"))
    index, _ = search_index.updated(index, docs.filter(stale).select("file_path").distinct(), docs.filter(stale))
    index = search_index.store_index(index, scratch_folder(spark, "search-index"))
    return search_index.search_index(index, "license the", None).select("node_id", F.round("score", 6).alias("score"))


@query("knn_l2", "SELECT vec_id AS node_id, ROUND(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 10")
def _knn(spark, d):
    vectors = view(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    target = vectors.filter("node_id = 0").first()["embedding"]
    return search.knn_l2(vectors, target, 10).select("node_id", F.round("distance", 6).alias("distance"))


# --- audit ----------------------------------------------------------------------------


@query(
    "lcom4",
    ctes("methods", "method_calls", recursive=True) + """, e AS (SELECT class_name, src, dst FROM method_calls UNION SELECT class_name, dst, src FROM method_calls),
 r AS (SELECT class_name, method AS a, method AS b FROM methods UNION SELECT r.class_name, r.a, e.dst FROM r JOIN e ON e.class_name = r.class_name AND e.src = r.b)
 SELECT class_name, COUNT(DISTINCT low) AS lcom4 FROM (SELECT class_name, a, MIN(b) AS low FROM r GROUP BY class_name, a) AS c GROUP BY class_name""",
)
def _lcom4(spark, d):
    return audit.lcom4(view(spark, d, "methods"), view(spark, d, "method_calls"))


RISK_BUS = ", bus AS (" + _bus_sql("supplier_blame", SINGLE) + ")"


@query(
    "test_risk",
    METRICS + RISK_BUS + ", covered AS (" + ctes("supplier_covers") + """ SELECT * FROM supplier_covers),
 c AS (SELECT 'supp/' || CAST(l_suppkey AS STRING) AS file_path, COUNT(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY l_suppkey)
 SELECT file_path, 'untested_high_fan_out' AS reason FROM metrics WHERE file_path NOT IN (SELECT file_path FROM covered) AND fan_out >= 400
 UNION ALL SELECT c.file_path, 'untested_high_churn' FROM metrics JOIN c ON c.file_path = metrics.file_path WHERE c.file_path NOT IN (SELECT file_path FROM covered) AND commits >= 500
 UNION ALL SELECT bus.file_path, 'single_author_high_fan_in' FROM metrics JOIN bus ON bus.file_path = metrics.file_path WHERE bus_factor = 1 AND fan_in >= 10""",
)
def _risk(spark, d):
    m = _metrics(spark, d)
    untested = m.join(view(spark, d, "supplier_covers"), "file_path", "left_anti")
    return audit.test_risk(m, _supplier_churn(spark, d), history.bus_factor(view(spark, d, "supplier_blame"), SINGLE), untested, 400, 500, 10)


@query("health_score", "SELECT CAST(o_custkey AS STRING) AS scope, CAST(ROUND(GREATEST(100 - SUM(CASE o_orderpriority WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 5 WHEN '3-MEDIUM' THEN 2 ELSE 0.5 END), 0)) AS INT) AS health, COUNT(*) AS findings FROM orders GROUP BY o_custkey")
def _health(spark, d):
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    return audit.health_score(view(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("scope"), severity.alias("severity")), "scope")


@query(
    "cycle_pivots",
    ctes("event_edges", recursive=True) + SCC_SQL.format(e="event_edges").replace(" SELECT LEAST", ", scc AS (SELECT LEAST", 1) + """),
 m AS (SELECT component, len(members) AS size, unnest(members) AS file_path FROM scc),
 ca AS (SELECT m.component, m.file_path, COUNT(e.src) AS fan_in FROM m LEFT JOIN event_edges e ON e.dst = m.file_path AND e.src NOT IN (SELECT file_path FROM m AS o WHERE o.component = m.component) GROUP BY m.component, m.file_path)
 SELECT component, file_path AS pivot, fan_in, size FROM (SELECT ca.*, size, ROW_NUMBER() OVER (PARTITION BY ca.component ORDER BY fan_in DESC, ca.file_path) AS r FROM ca JOIN m ON m.file_path = ca.file_path) AS x WHERE r = 1""",
)
def _pivots(spark, d):
    edges = view(spark, d, "event_edges")
    return audit.cycle_pivots(graph.scc_cycles(edges), edges)


@query("layer_violations", ctes("supplier_edges", "supplier_layers") + "SELECT src, dst, a.layer AS src_layer, b.layer AS dst_layer, COUNT(*) AS edges FROM supplier_edges JOIN supplier_layers a ON a.file_path = src JOIN supplier_layers b ON b.file_path = dst WHERE a.layer < b.layer GROUP BY src, dst, a.layer, b.layer")
def _layers(spark, d):
    return audit.layer_violations(view(spark, d, "supplier_edges"), view(spark, d, "supplier_layers"))


@query("main_sequence", METRICS + ", k AS (" + ctes("supplier_classes") + """ SELECT file_path, AVG(CAST(abstract AS DOUBLE)) AS a FROM supplier_classes GROUP BY file_path)
 SELECT m.file_path, ROUND(COALESCE(a, 0), 6) AS abstractness, ROUND(instability, 6) AS instability, ROUND(ABS(COALESCE(a, 0) + instability - 1), 6) AS distance FROM metrics m LEFT JOIN k ON k.file_path = m.file_path""")
def _main_sequence(spark, d):
    found = audit.main_sequence(_metrics(spark, d), view(spark, d, "supplier_classes"))
    return found.select("file_path", *[F.round(c, 6).alias(c) for c in ("abstractness", "instability", "distance")])


@query("churn_trend", ctes("history") + """, m AS (SELECT file_path, YEAR(ts) * 12 + MONTH(ts) AS month, COUNT(DISTINCT commit_id) AS commits FROM history GROUP BY ALL)
 SELECT file_path, COUNT(*) AS months, CAST(SUM(commits) AS BIGINT) AS commits, ROUND(REGR_SLOPE(commits, month), 6) + 0.0 AS slope FROM m GROUP BY file_path""")
def _trend(spark, d):
    return audit.churn_trend(view(spark, d, "history")).withColumn("slope", F.round("slope", 6) + 0.0)


@query("class_coupling", ctes("part_methods", "calls") + """, p AS (SELECT DISTINCT a.class_name AS a, b.class_name AS b, dst FROM calls JOIN part_methods a ON a.method = src JOIN part_methods b ON b.method = dst WHERE a.class_name <> b.class_name),
 c AS (SELECT x, COUNT(*) AS cbo FROM (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p) AS u GROUP BY x), r AS (SELECT a, COUNT(DISTINCT dst) AS called FROM p GROUP BY a), o AS (SELECT class_name, COUNT(*) AS own FROM part_methods GROUP BY class_name)
 SELECT o.class_name, COALESCE(cbo, 0) AS cbo, own + COALESCE(called, 0) AS rfc FROM o LEFT JOIN c ON c.x = o.class_name LEFT JOIN r ON r.a = o.class_name""")
def _class_coupling(spark, d):
    return audit.class_coupling(view(spark, d, "part_methods"), view(spark, d, "calls"))


@query("change_risk", f"SELECT h.file_path, ROUND(instability * hotspot_score, 6) AS risk FROM ({HOT_SQL}) AS h JOIN (" + METRICS + "SELECT file_path, instability FROM metrics) AS i ON i.file_path = h.file_path")
def _change_risk(spark, d):
    m = _metrics(spark, d)
    return audit.change_risk(m, history.hotspots(m, _supplier_churn(spark, d))).withColumn("risk", F.round("risk", 6))


@query("temporal_jaccard", _pairs_sql("history_nation", 5, 0.08).replace("LEAST(x.n, y.n)", "(x.n + y.n - shared_commits)"))
def _temporal_jaccard(spark, d):
    return history.temporal_coupling(view(spark, d, "history_nation"), 5, 0.08, jaccard=True)


# --- extraction -----------------------------------------------------------------------

FILE = "'pkg/m' || CAST(p_partkey AS STRING) || '.py'"
CLASS = "'C' || CAST(p_partkey AS STRING)"


@query(
    "extract_nodes",
    f"""SELECT 'File' AS kind, 'm' || CAST(p_partkey AS STRING) || '.py' AS name, {FILE} AS qualified_name, CAST(1 AS INT) AS line_start, CAST(12 AS INT) AS line_end, NULL AS parent_name FROM part
 UNION ALL SELECT 'Class', {CLASS}, {FILE} || '::' || {CLASS}, 4, 9, NULL FROM part
 UNION ALL SELECT 'Method', 'run', {FILE} || '::' || {CLASS} || '.run', 5, 7, {CLASS} FROM part
 UNION ALL SELECT 'Method', 'help', {FILE} || '::' || {CLASS} || '.help', 8, 9, {CLASS} FROM part
 UNION ALL SELECT 'Function', 'util', {FILE} || '::util', 11, 12, NULL FROM part""",
)
def _extract_nodes(spark, d):
    return nodes_of(extract_sources(view(spark, d, "sources"), spark.sparkContext.defaultParallelism)).select("kind", "name", "qualified_name", "line_start", "line_end", "parent_name")


@query(
    "extract_edges",
    f"""SELECT 'IMPORTS_FROM' AS kind, {FILE} AS src, 'os' AS dst, CAST(1 AS INT) AS line FROM part
 UNION ALL SELECT 'IMPORTS_FROM', {FILE}, 'pkg.m' || CAST(p_partkey + 1 AS STRING), 2 FROM part
 UNION ALL SELECT 'CONTAINS', {FILE}, {FILE} || '::' || {CLASS}, 4 FROM part
 UNION ALL SELECT 'INHERITS', {FILE} || '::' || {CLASS}, 'Base' || CAST(p_size AS STRING), 4 FROM part
 UNION ALL SELECT 'HAS_METHOD', {FILE} || '::' || {CLASS}, {FILE} || '::' || {CLASS} || '.run', 5 FROM part
 UNION ALL SELECT 'HAS_METHOD', {FILE} || '::' || {CLASS}, {FILE} || '::' || {CLASS} || '.help', 8 FROM part
 UNION ALL SELECT 'CONTAINS', {FILE}, {FILE} || '::util', 11 FROM part
 UNION ALL SELECT 'USES_TYPE', {FILE}, 'Item' || CAST(p_size % 7 AS STRING), 5 FROM part
 UNION ALL SELECT 'CALLS', {FILE} || '::' || {CLASS} || '.run', {FILE} || '::' || {CLASS} || '.help', 6 FROM part
 UNION ALL SELECT 'CALLS', {FILE} || '::' || {CLASS} || '.run', {FILE} || '::util', 7 FROM part""",
)
def _extract_edges(spark, d):
    return edges_of(extract_sources(view(spark, d, "sources"), spark.sparkContext.defaultParallelism)).select("kind", "src", "dst", "line")


# --- the whole report -----------------------------------------------------------------

REPORT = {
    "hub": ("god_modules", "file_path", "fan_in"),
    "hotspot": ("report_hotspots", "file_path", "hotspot_score"),
    "pair": ("temporal_coupling", "file_a || ' ' || file_b", "shared_commits"),
    "single author": ("bus_factor", "file_path", "CASE WHEN bus_factor = 1 THEN top_author_pct END"),
    "cycle": ("scc_cycles", "CAST(component AS STRING)", "LENGTH_OF(members)"),
}


@query("report_sections", " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, CAST({value} AS DOUBLE) AS amount FROM ({ORACLES[source]}) AS s WHERE {value} IS NOT NULL" for section, (source, name, value) in REPORT.items()).replace("LENGTH_OF(", "LEN("))
def _report_sections(spark, d):
    """The sections that a report has besides its modules, one after the other."""
    out = None
    for section, (source, name, value) in REPORT.items():
        rows = QUERIES[source](spark, d).selectExpr(f"'{section}' AS section", f"{name} AS name", f"CAST({value} AS DOUBLE) AS amount".replace("LENGTH_OF(", "SIZE(")).filter("amount IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out
