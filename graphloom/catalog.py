"""Where queries and their SQL for another engine are registered, and the SQL of the graph views that they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import views

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(c, n: int = 6):
    return F.round(c, n)


OV = """ov AS (SELECT l_orderkey AS graph_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
 l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS INT) AS v, l_returnflag || l_linestatus AS label,
 l_suppkey AS supplier, o_custkey AS grp, weight FROM lineitem JOIN (SELECT o_orderkey, o_custkey, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS weight
 FROM orders) ON l_orderkey = o_orderkey)"""
PATH = f"{OV}, ob AS (SELECT graph_id, v - 1 AS src, v AS trg FROM ov WHERE v > 0)"
CHORDS = f"""{OV}, ob AS (SELECT graph_id, v - 1 AS src, v AS trg FROM ov WHERE v > 0 UNION SELECT a.graph_id, a.v, b.v FROM ov a JOIN ov b
 ON a.graph_id = b.graph_id AND a.supplier = b.supplier AND a.v < b.v)"""
NEAR = "near AS (SELECT graph_id, src AS v, trg AS w FROM ob UNION ALL SELECT graph_id, trg, src FROM ob)"
FREQ = "p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM ov)) AS lw FROM ov GROUP BY label)"


def order_lines(spark, sf_dir):
    return views.order_vertices(spark, sf_dir)
