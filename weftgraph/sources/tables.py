"""Property graphs projected from relational tables.

Each projection is one SQL text with the tables as parameters, so the same
definition serves Spark and any other SQL engine that checks the results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftgraph.schema import PropertyGraph

_TYPE_BY_KEY = "CASE {key} % 8 WHEN 0 THEN 'module' WHEN 1 THEN 'component' WHEN 2 THEN 'hook' WHEN 3 THEN 'page' WHEN 4 THEN 'api' WHEN 5 THEN 'query-key' WHEN 6 THEN 'context' ELSE 'store' END"
_EDGE_BY_TYPE = "CASE {type} WHEN 'component' THEN 'component' WHEN 'api' THEN 'api-call' WHEN 'context' THEN 'context' WHEN 'query-key' THEN 'query-key' ELSE 'import' END"


def _edge(src: str, dst: str, kind: str, tail: str) -> str:
    return f"SELECT {src} || '->' || {dst} AS id, {src} AS src, {dst} AS dst, '{kind}' AS type {tail}"


def _key(prefix: str, column: str) -> str:
    return f"'{prefix}/' || CAST({column} AS STRING)"


#: rows of the catalogue: regions, nations, customers, suppliers, parts and orders
CATALOGUE_NODES = " UNION ALL ".join(
    f"SELECT {_key(name, key)} AS id, {label} AS label, '{kind}' AS type, '{name}/' || {label} AS file, 1 AS line, '{name}' AS cluster FROM [{name}]"
    for name, key, label, kind in (
        ("region", "r_regionkey", "r_name", "context"),
        ("nation", "n_nationkey", "n_name", "store"),
        ("customer", "c_custkey", "c_name", "component"),
        ("supplier", "s_suppkey", "s_name", "hook"),
        ("part", "p_partkey", "p_name", "api"),
        ("orders", "o_orderkey", "CAST(o_orderkey AS STRING)", "module"),
    )
)
#: foreign keys
CATALOGUE_EDGES = " UNION ALL ".join(
    (
        _edge(_key("nation", "n_nationkey"), _key("region", "n_regionkey"), "context", "FROM [nation]"),
        _edge(_key("customer", "c_custkey"), _key("nation", "c_nationkey"), "import", "FROM [customer]"),
        _edge(_key("supplier", "s_suppkey"), _key("nation", "s_nationkey"), "import", "FROM [supplier]"),
        _edge(_key("orders", "o_orderkey"), _key("customer", "o_custkey"), "component", "FROM [orders]"),
        _edge(_key("orders", "l_orderkey"), _key("part", "l_partkey"), "api-call", "FROM (SELECT DISTINCT l_orderkey, l_partkey FROM [lineitem]) AS op"),
        _edge(_key("orders", "l_orderkey"), _key("supplier", "l_suppkey"), "import", "FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM [lineitem]) AS os"),
    )
)
SUPPLIER_NODES = f"""
SELECT {_key("supplier", "s_suppkey")} AS id, s_name AS label, {_TYPE_BY_KEY.format(key="s_suppkey")} AS type,
       n_name || '/' || s_name AS file, 1 AS line, n_name AS cluster
FROM [supplier] JOIN [nation] ON s_nationkey = n_nationkey"""
#: suppliers of consecutive lines of an order
SUPPLIER_HOPS = "SELECT l_suppkey AS s, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS d FROM [lineitem]"
_SUPPLIER_EDGE = f"""
SELECT {_key("supplier", "s")} || '->' || {_key("supplier", "d")} AS id, {_key("supplier", "s")} AS src, {_key("supplier", "d")} AS dst,
       {_EDGE_BY_TYPE.format(type="(" + _TYPE_BY_KEY.format(key="d") + ")")} AS type"""
#: all followers of each
FOLLOWER_EDGES = f"""{_SUPPLIER_EDGE}
FROM (SELECT DISTINCT s, d FROM [hops] AS hops WHERE d IS NOT NULL AND s <> d) AS pairs"""
#: the [k] most frequent followers of each
SUPPLIER_EDGES = f"""{_SUPPLIER_EDGE}
FROM (SELECT s, d, row_number() OVER (PARTITION BY s ORDER BY n DESC, d) AS r
      FROM (SELECT s, d, count(*) AS n
            FROM [hops] AS hops
            WHERE d IS NOT NULL AND s <> d GROUP BY s, d) AS pairs) AS ordered
WHERE r <= [k]"""
TRADE_NODES = f"SELECT {_key('nation', 'n_nationkey')} AS id, n_name AS label, 'module' AS type, n_name AS file, 1 AS line, r_name AS cluster FROM [nation] JOIN [region] ON n_regionkey = r_regionkey"
#: nation of the supplier to nation of the customer, the [k] with most lines
TRADE_EDGES = f"""
SELECT {_key("nation", "s")} || '->' || {_key("nation", "d")} AS id, {_key("nation", "s")} AS src, {_key("nation", "d")} AS dst, 'import' AS type
FROM (SELECT s, d, row_number() OVER (PARTITION BY s ORDER BY n DESC, d) AS r
      FROM (SELECT s_nationkey AS s, c_nationkey AS d, count(*) AS n
            FROM [lineitem] JOIN [supplier] ON l_suppkey = s_suppkey JOIN [orders] ON l_orderkey = o_orderkey JOIN [customer] ON o_custkey = c_custkey
            WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey) AS pairs) AS ordered
WHERE r <= [k]"""
#: one row for each day, user and event type seen that day; ord counts days from the first
SNAPSHOTS = """
SELECT DISTINCT CAST(datediff('day', first_day, CAST(ts AS DATE)) AS BIGINT) AS ord, 'user/' || CAST(user_id AS STRING) AS src, 'event/' || event_type AS dst
FROM [events] CROSS JOIN (SELECT CAST(min(ts) AS DATE) AS first_day FROM [events]) AS f"""

#: users of each type of event and quarter of the users, a frame a day
DAILY_TYPES = """
SELECT CAST(datediff('day', first_day, CAST(ts AS DATE)) AS BIGINT) AS ord, 'event/' || event_type || '/' || CAST(user_id % 4 AS STRING) AS id, count(DISTINCT user_id) AS n
FROM [events] CROSS JOIN (SELECT CAST(min(ts) AS DATE) AS first_day FROM [events]) AS f
GROUP BY datediff('day', first_day, CAST(ts AS DATE)), event_type, user_id % 4"""

#: a tree of scripts: every fourth page is a library file, the others import the one before them, fetch their own address
#: and use a query key; chr() stands for braces and the dollar sign, which are marks of substitution
SCRIPTS = """
SELECT CASE WHEN page_id % 4 = 0 THEN 'lib/p' ELSE 'data/p' END || CAST(page_id AS STRING) || '.ts' AS path,
       CASE WHEN page_id % 4 = 0 THEN '// fetch(' || chr(39) || url || chr(39) || ')' || chr(10) || 'export const a = ' || CAST(page_id AS STRING) || chr(10)
            ELSE 'import ' || chr(123) || ' a ' || chr(125) || ' from "../lib/p' || CAST(page_id - page_id % 4 AS STRING) || '"' || chr(10) || '/* import "./none" */' || chr(10)
                 || 'const r = fetch(' || chr(96) || url || '/' || chr(36) || chr(123) || 'a' || chr(125) || chr(96)
                 || CASE WHEN page_id % 3 = 0 THEN ', ' || chr(123) || ' body: "), method", method: "post" ' || chr(125) ELSE '' END || ')' || chr(10)
                 || 'useQuery(' || chr(123) || ' queryKey: ["pages",   ' || CAST(page_id % 7 AS STRING) || '], retry: (n) => n < 3 ' || chr(125) || ')' || chr(10) END AS text
FROM [pages]"""

#: the same with the month of the order
MONTHLY_HOPS = """SELECT l_suppkey AS s, 12 * year(o_orderdate) + month(o_orderdate) AS month,
                               lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS d
                        FROM [lineitem] JOIN [orders] ON l_orderkey = o_orderkey"""
#: today's supplier graph with [k] followers, each edge in every month from the first in which it was seen
SUPPLIER_HISTORY = f"""
SELECT CAST(m.ord AS BIGINT) AS ord, e.src, e.dst
FROM (SELECT {_key("supplier", "s")} AS src, {_key("supplier", "d")} AS dst, first
      FROM (SELECT s, d, first, row_number() OVER (PARTITION BY s ORDER BY n DESC, d) AS r
            FROM (SELECT s, d, count(*) AS n, min(month) AS first
                  FROM [hops] AS hops
                  WHERE d IS NOT NULL AND s <> d GROUP BY s, d) AS pairs) AS ordered
      WHERE r <= [k]) AS e
JOIN (SELECT month, row_number() OVER (ORDER BY month) - 1 AS ord FROM (SELECT DISTINCT 12 * year(o_orderdate) + month(o_orderdate) AS month FROM [orders]) AS months) AS m
  ON m.month >= e.first"""

PROJECTIONS = {
    "catalogue": (CATALOGUE_NODES, CATALOGUE_EDGES),
    "suppliers": (SUPPLIER_NODES, SUPPLIER_EDGES),
    "followers": (SUPPLIER_NODES, FOLLOWER_EDGES),
    "trade": (TRADE_NODES, TRADE_EDGES),
}


#: what stands for [hops] in a projection
HOPS = {SUPPLIER_EDGES: SUPPLIER_HOPS, FOLLOWER_EDGES: SUPPLIER_HOPS, SUPPLIER_HISTORY: MONTHLY_HOPS}
#: tables that are dealt out by a key before a projection groups them, each to the parts of the first
DEALT = {CATALOGUE_EDGES: {"lineitem": "l_orderkey", "orders": "o_orderkey"}, SUPPLIER_HOPS: {"lineitem": "l_orderkey"}, MONTHLY_HOPS: {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
#: rows of the first dealt table in a part
PART = 1 << 19


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\[(\w+)\]", sql)) - {"k", "hops"})


def for_sql(sql: str, k: int = 1) -> str:
    """The projection over views of the tables' names."""
    whole = sql.replace("[hops]", f"({HOPS.get(sql)})")
    return re.sub(r"\[(\w+)\]", lambda m: str(k) if m[1] == "k" else m[1], whole)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts_of(spark: SparkSession, folder: str, sql: str) -> int | None:
    """Parts among which the projection's work is dealt out, so that a task holds as much whatever the size of the tables."""
    dealt = DEALT.get(HOPS.get(sql, sql))
    if dealt is None:
        return None
    rows = table(spark, folder, next(iter(dealt))).count()  # from the footers
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART))


def projected(spark: SparkSession, folder: str, sql: str, k: int = 1, parts: int | None = None) -> DataFrame:
    """The projection over the Parquet tables of a folder.  ``parts``: ``parts_of`` it, if known."""
    parts = parts_of(spark, folder, sql) if parts is None else parts
    given = {name: table(spark, folder, name) for name in tables_of(sql)}
    given |= {name: given[name].repartition(parts, key) for name, key in DEALT.get(sql, {}).items()}
    if sql in HOPS:  # pairs that are nearly all different: they are counted where they meet
        given["hops"] = projected(spark, folder, HOPS[sql], k, parts).filter("s <> d").repartition(parts, "s", "d")
    text = re.sub(r"\[(\w+)\]", lambda m: str(k) if m[1] == "k" else "{" + m[1] + "}", sql)
    text = text.replace("datediff('day', first_day, CAST(ts AS DATE))", "datediff(CAST(ts AS DATE), first_day)")
    return spark.sql(text, **given)


def graph(spark: SparkSession, folder: str, name: str, k: int = 1) -> PropertyGraph:
    nodes, edges = PROJECTIONS[name]
    parts = parts_of(spark, folder, edges)
    return PropertyGraph(projected(spark, folder, nodes, k), projected(spark, folder, edges, k, parts), {"project": name}, parts)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, src, dst): edges of one graph a day."""
    return projected(spark, folder, SNAPSHOTS)
