"""The register of queries, each with the SQL that its result is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The corpus as SQL; queries continue with their own WITH items.
CORPUS = """WITH corpus AS (
  SELECT doc_id AS class_id, source || '.' || lang AS package, source || '.' || lang || '.D' || doc_id AS full_name,
    'x.' || source || '.d' || doc_id AS raw_name, 'D' || doc_id AS simple_name, text AS code, source, lang, n_chars
  FROM documents)"""
LINES = (
    CORPUS
    + """, lines AS (
  SELECT class_id, generate_subscripts(string_split(code, chr(10)), 1)::INT AS line_no, unnest(string_split(code, chr(10))) AS line FROM corpus)"""
)
EDGES = """WITH usage AS (
  SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL
  SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
edges AS (SELECT DISTINCT src, dst FROM usage WHERE src <> dst)"""
PARTS = """WITH RECURSIVE li AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem),
graph AS (SELECT p AS src, s AS dst FROM li UNION SELECT s, p FROM li)"""
CALLS = """WITH RECURSIVE steps AS (
  SELECT event_type || '.' || (floor(value)::BIGINT % 10)::INT AS caller,
    lead(event_type || '.' || (floor(value)::BIGINT % 10)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events),
calls AS (SELECT caller, callee, count(*) AS n FROM steps WHERE callee IS NOT NULL GROUP BY 1, 2)"""


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a VALUES list for SQL."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"
