"""The TPC-H-like tables seen as histories, blame, graphs, symbols and documents.

Each view is one SQL text over ``{table}`` placeholders that Spark and DuckDB read
alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tanglemap.scratch import Table, workspace

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "history": """
        SELECT CAST(l_orderkey AS STRING) AS commit_id, o_orderdate AS ts, CAST(l_partkey AS STRING) AS file_path,
               CAST(l_suppkey AS STRING) AS author, CAST(FLOOR(l_quantity) AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "history_nation": """
        SELECT CAST(l_orderkey AS STRING) AS commit_id, n_name AS file_path
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "blame": """
        SELECT CAST(l_partkey AS STRING) AS file_path, CAST(l_suppkey AS STRING) AS author,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS INT) AS line_no
        FROM {lineitem}""",
    "supplier_blame": """
        SELECT 'supp/' || CAST(l_suppkey AS STRING) AS file_path, l_returnflag AS author,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS line_no
        FROM {lineitem}""",
    "supplier_covers": """
        SELECT DISTINCT 'supp/' || CAST(a.l_suppkey AS STRING) AS file_path
        FROM {lineitem} AS a JOIN {lineitem} AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND b.l_suppkey = a.l_suppkey + 1""",
    "supplier_files": "SELECT 'supp/' || CAST(s_suppkey AS STRING) AS file_path FROM {supplier}",
    "supplier_edges": """
        SELECT CASE WHEN line % 4 = 0 THEN 'USES_TYPE' ELSE 'IMPORTS_FROM' END AS kind, 'supp/' || CAST(a AS STRING) AS src, 'supp/' || CAST(b AS STRING) AS dst
        FROM (SELECT l_linenumber AS line, l_suppkey AS a,
                     LEAD(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM {lineitem}) AS steps
        WHERE b IS NOT NULL""",
    "nation_edges": """
        SELECT src, dst FROM (SELECT src, dst, n, AVG(n) OVER () AS mean FROM (
            SELECT c_nationkey AS src, s_nationkey AS dst, COUNT(*) AS n
            FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
            WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) AS pairs) AS rated
        WHERE n > 1.1 * mean""",
    "event_edges": """
        SELECT DISTINCT src, dst FROM (
            SELECT CAST(user_id AS STRING) || '/' || event_type AS src, CAST(user_id AS STRING) || '/' || LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events}) AS steps
        WHERE dst IS NOT NULL AND src <> dst""",
    "customer_tree": """
        SELECT 'c' || CAST(c_custkey AS STRING) AS src, 'c' || CAST(CAST(FLOOR(c_custkey / 2) AS BIGINT) AS STRING) AS dst, c_custkey AS id
        FROM {customer} WHERE c_custkey > 1""",
    "customer_chain": """
        SELECT 'c' || CAST(c_custkey AS STRING) AS src, 'c' || CAST(c_custkey - 1 AS STRING) AS dst, c_custkey AS id
        FROM {customer} WHERE c_custkey % 200 <> 0""",
    "customer_cycle": """
        SELECT 'c' || CAST(c_custkey AS STRING) AS src, 'c' || CAST(CASE WHEN c_custkey % 100 = 99 THEN c_custkey - 99 ELSE c_custkey + 1 END AS STRING) AS dst, c_custkey AS id
        FROM {customer}""",
    "customer_classes": "SELECT 'c' || CAST(c_custkey AS STRING) AS qualified_name FROM {customer}",
    "symbols": """
        SELECT CAST(p_partkey AS STRING) AS qualified_name, p_name || '/' || p_type AS name,
               CASE WHEN p_size % 4 = 0 THEN 'tests/' ELSE 'src/' END || CAST(p_partkey % 50 AS STRING) || '.py' AS file_path,
               CASE WHEN p_size % 3 = 0 THEN 'Class' WHEN p_size % 3 = 1 THEN 'Function' ELSE 'Method' END AS kind, p_size AS line_start
        FROM {part}""",
    "open_calls": """
        SELECT DISTINCT CAST(l_orderkey AS STRING) AS src, p_name || '/' || p_type AS dst
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "test_calls": """
        SELECT DISTINCT CAST(a.l_partkey AS STRING) AS src, callee.p_name || '/' || callee.p_type AS dst, 'tests/' || CAST(a.l_partkey % 50 AS STRING) || '.py' AS file_path, CAST(a.l_linenumber AS INT) AS line
        FROM {lineitem} AS a JOIN {lineitem} AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
             JOIN {part} AS caller ON caller.p_partkey = a.l_partkey JOIN {part} AS callee ON callee.p_partkey = b.l_partkey
        WHERE caller.p_size % 4 = 0""",
    "covers": """
        SELECT DISTINCT CAST(b.l_partkey AS STRING) AS dst
        FROM {lineitem} AS a JOIN {lineitem} AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN {part} ON p_partkey = a.l_partkey
        WHERE p_size % 4 = 0 AND a.l_partkey % 50 = b.l_partkey % 50""",
    "calls": """
        SELECT 'CALLS' AS kind, CAST(a.l_partkey AS STRING) AS src, CAST(b.l_partkey AS STRING) AS dst, CAST(a.l_linenumber AS INT) AS line
        FROM {lineitem} AS a JOIN {lineitem} AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "rich_nodes": """
        SELECT CAST(p_partkey AS STRING) AS qualified_name, CASE WHEN p_size % 3 = 0 THEN 'C' || CAST(p_size % 7 AS STRING) ELSE p_name END AS name,
               CASE WHEN p_size % 4 = 0 THEN 'tests/' ELSE 'src/' END || CAST(p_partkey % 50 AS STRING) || '.py' AS file_path,
               CASE WHEN p_size % 3 = 0 THEN 'Class' WHEN p_size % 3 = 1 THEN 'Function' ELSE 'Method' END AS kind, p_size AS line_start, p_size + 2 AS line_end, 'python' AS language,
               CASE WHEN p_size % 3 = 2 THEN 'C' || CAST(p_partkey % 7 AS STRING) END AS parent_name, 'def ' || p_brand AS signature, CASE WHEN p_size % 5 > 0 THEN p_type END AS docstring
        FROM {part}
        UNION ALL
        SELECT DISTINCT CASE WHEN p_size % 4 = 0 THEN 'tests/' ELSE 'src/' END || CAST(p_partkey % 50 AS STRING) || '.py', CAST(p_partkey % 50 AS STRING) || '.py',
               CASE WHEN p_size % 4 = 0 THEN 'tests/' ELSE 'src/' END || CAST(p_partkey % 50 AS STRING) || '.py', 'File', 1, 99, 'python', NULL, NULL, NULL
        FROM {part}""",
    "rich_imports": """
        SELECT DISTINCT 'IMPORTS_FROM' AS kind, CASE WHEN p_size % 4 = 0 THEN 'tests/' ELSE 'src/' END || CAST(p_partkey % 50 AS STRING) || '.py' AS file_path,
               CASE WHEN p_size % 4 = 0 THEN 'tests/' ELSE 'src/' END || CAST(p_partkey % 50 AS STRING) || '.py' AS src, 'pkg.' || p_type AS dst, p_size AS line
        FROM {part}""",
    "supplier_layers": "SELECT 'supp/' || CAST(s_suppkey AS STRING) AS file_path, CAST(s_nationkey AS INT) AS layer FROM {supplier}",
    "supplier_classes": "SELECT 'supp/' || CAST(l_suppkey AS STRING) AS file_path, l_returnflag = 'A' AS abstract FROM {lineitem}",
    "part_methods": "SELECT CAST(p_partkey AS STRING) AS method, p_type AS class_name FROM {part}",
    "paths": """
        SELECT p_partkey AS id, LOWER(REPLACE(p_type, ' ', '_')) || '/' || CASE WHEN p_size % 4 = 0 THEN 'test_' ELSE '' END || REPLACE(p_name, ' ', '_') || CAST(p_partkey AS STRING)
               || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '_test.py' ELSE '.md' END AS path
        FROM {part}""",
    "imports": "SELECT 'IMPORTS_FROM' AS kind, CAST(page_id AS STRING) AS src, url AS dst, CAST(page_id AS STRING) || '.py' AS file_path FROM {pages}",
    "docs": "SELECT doc_id AS node_id, source AS name, text AS body, lang AS kind FROM {documents}",
    "stored_files": "SELECT 'f' || CAST(o_orderkey AS STRING) AS file_path, o_orderstatus || CAST(o_orderkey % 7 AS STRING) AS file_hash FROM {orders} WHERE o_orderkey % 10 <> 3",
    "current_files": "SELECT 'f' || CAST(o_orderkey AS STRING) AS file_path, o_orderstatus || CAST(CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE o_orderkey % 7 END AS STRING) AS file_hash FROM {orders} WHERE o_orderkey % 10 <> 5",
    "old_edges": """
        SELECT 'IMPORTS_FROM' AS kind, 'supp/' || CAST(a AS STRING) AS src, 'supp/' || CAST(b AS STRING) AS dst
        FROM (SELECT o_orderdate AS ts, l_suppkey AS a, LEAD(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b
              FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) AS steps
        WHERE b IS NOT NULL AND ts < TIMESTAMP '1995-01-01 00:00:00'""",
    "method_calls": """
        SELECT DISTINCT CAST(l_orderkey AS STRING) AS class_name, CAST(l_suppkey % 9 AS STRING) AS src, CAST(b AS STRING) AS dst
        FROM (SELECT l_orderkey, l_suppkey, l_returnflag, LEAD(l_suppkey % 9) OVER w AS b, LEAD(l_returnflag) OVER w AS flag FROM {lineitem}
              WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS steps
        WHERE b IS NOT NULL AND l_returnflag = flag""",
    "methods": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS class_name, CAST(l_suppkey % 9 AS STRING) AS method FROM {lineitem}",
    "flags": "SELECT event_id, props FROM {events}",
    "log_lines": """
        SELECT CAST(o_orderkey AS BIGINT) AS file_no, 0 AS line_no, LPAD(CAST(o_orderkey AS STRING), 40, '0') AS line FROM {orders}
        UNION ALL
        SELECT CAST(l_orderkey AS BIGINT), CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT),
               CASE WHEN l_linenumber % 5 = 0 THEN '-' ELSE CAST(CAST(FLOOR(l_quantity) AS BIGINT) AS STRING) END || CHR(9) || CAST(l_linenumber AS STRING) || CHR(9) || 'src/' || CAST(l_partkey AS STRING) || '.py'
        FROM {lineitem}""",
    "sources": """
        SELECT 'pkg/m' || CAST(p_partkey AS STRING) || '.py' AS path,
               'import os' || CHR(10) || 'from pkg.m' || CAST(p_partkey + 1 AS STRING) || ' import util' || CHR(10) || CHR(10)
               || 'class C' || CAST(p_partkey AS STRING) || '(Base' || CAST(p_size AS STRING) || '):' || CHR(10)
               || '    def run(self, x: Item' || CAST(p_size % 7 AS STRING) || '):' || CHR(10) || '        self.help()' || CHR(10) || '        return util()' || CHR(10)
               || '    def help(self):' || CHR(10) || '        return "' || p_name || '"' || CHR(10) || CHR(10) || 'def util():' || CHR(10) || '    return 1' || CHR(10) AS text
        FROM {part}""",
    "blame_lines": """
        SELECT CAST(l_partkey AS STRING) || '.py' AS file_path, CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS INT) AS line_no,
               CASE WHEN l_linenumber % 3 = 0 THEN 'summary x' ELSE 'author ' || CAST(l_suppkey AS STRING) END AS line
        FROM {lineitem}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **used)


PART_ROWS = 6_000_000  # rows of a table that a part of a view reads
MOST_PARTS = 8  # each part scans the whole table


def distinct_view(spark: SparkSession, sf_dir: str, name: str, table: str, key: str) -> DataFrame:
    """A view of distinct rows that reads ``table`` alone and with itself at equal ``key``, stored. It
    is made part by part of the keys, and the shuffle files of one part go before the next, so
    that the disk holds a part's joins at a time; then the parts' rows are made distinct."""
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    parts = min(MOST_PARTS, max(1, -(-used[table].count() // PART_ROWS)))
    of = F.pmod(F.xxhash64(key), F.lit(parts))
    with workspace(spark, name):
        made = [Table(spark.sql(text, **used | {table: used[table].filter(of == part)}), name).read() for part in range(parts)]
        rows = reduce(DataFrame.unionByName, made)
        out = Table(rows.distinct() if parts > 1 else rows, name, kept=True)
    return out.read()


def ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of views for DuckDB."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
