"""Relational queries over the star schema and their SQL.

Most are one text that both engines run, Spark through the engine's SQL front end. Catalyst chooses the physical plan:
filters and columns reach the Parquet scan, comma joins become hash joins, ORDER
BY with LIMIT becomes a top-k.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import TABLES, table
from .frontend import Engine

#: key: SQL text that both engines run; {name} stands for a table.
BOTH: dict[str, str] = {
    # scans and lookups
    "scan_filter": "SELECT p_partkey, p_name, p_size FROM {part} WHERE p_size >= 40 AND p_brand = 'Brand#13' ORDER BY p_partkey LIMIT 50",
    "lookup_by_id": "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey = 7",
    "symbols_by_file": "SELECT doc_id, lang, n_chars FROM {documents} WHERE source = 'src3'",
    "symbols_by_kind": "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = 'BUILDING'",
    "chunks_by_symbol": "SELECT doc_id, text FROM {documents} WHERE source = 'src5'",
    "sql_passthrough": "SELECT o_orderpriority, COUNT(*) AS n FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 100",
    # projections
    "select_star": "SELECT * FROM {supplier}",
    "project_alias": "SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS balance FROM {customer} WHERE c_acctbal < 0",
    "table_alias": "SELECT s.s_name AS name, s.s_acctbal AS balance FROM {supplier} AS s WHERE s.s_nationkey = 3",
    # predicates
    "filter_bool": "SELECT p_partkey FROM {part} WHERE (p_size > 45 OR p_size < 3) AND NOT (p_brand = 'Brand#11')",
    "filter_compare": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > 250000 AND o_orderstatus <> 'F' AND o_custkey <= 1000 AND o_custkey >= 10 AND o_orderkey < 14000",
    "filter_like": "SELECT n_nationkey, n_name FROM {nation} WHERE n_name LIKE 'NATION%1%' AND n_name NOT LIKE '%_19'",
    "filter_ilike": "SELECT p_partkey, p_type FROM {part} WHERE p_type ILIKE '%BRASS%' OR p_name NOT ILIKE '%e%'",
    "filter_in": "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "filter_null": """SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
        WHERE l.quality IS NULL AND NULLIF(d.lang, 'en') IS NOT NULL""",
    "filter_between": "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_custkey NOT BETWEEN 100 AND 200",
    "filter_arith": "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE l_extendedprice * (1 - l_discount) > 80000 AND l_quantity + l_linenumber < 45",
    # joins
    "join_comma_equi": """SELECT n.n_name, COUNT(*) AS customers FROM {customer} c, {nation} n
        WHERE c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
    "join_inner": """SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
        WHERE o.o_totalprice > 200000""",
    "join_cross": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n",
    "join_left": "SELECT d.doc_id, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "join_self": """SELECT a.n_name AS a_name, b.n_name AS b_name FROM {nation} a JOIN {nation} b
        ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "join_three_way": """SELECT r.r_name, COUNT(*) AS orders, ROUND(SUM(o.o_totalprice), 2) AS total
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
        JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""",
    "join_cte": """WITH big AS (SELECT o_orderkey, o_custkey FROM {orders} WHERE o_totalprice > 300000)
        SELECT c.c_name, COUNT(*) AS n FROM big JOIN {customer} c ON big.o_custkey = c.c_custkey GROUP BY c.c_name""",
    # aggregates
    "group_count": """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, ROUND(SUM(l_extendedprice), 2) AS total
        FROM {lineitem}
        WHERE l_quantity >= 10 AND l_shipdate IS NOT NULL AND l_returnflag IN ('A', 'N', 'R')
        GROUP BY l_returnflag, l_linestatus HAVING cnt > 1
        ORDER BY cnt DESC, l_returnflag, l_linestatus LIMIT 20""",
    "count_column": """SELECT d.lang, COUNT(*) AS docs, COUNT(l.quality) AS labelled, COUNT(NULLIF(l.toxic, 0)) AS toxic
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang""",
    "agg_sum": "SELECT l_suppkey, ROUND(SUM(l_quantity), 2) AS quantity, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM {lineitem} GROUP BY l_suppkey",
    "agg_avg": "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS balance FROM {customer} GROUP BY c_mktsegment",
    "agg_min_max": "SELECT p_brand, MIN(p_size) AS smallest, MAX(p_size) AS largest, MIN(p_name) AS first_name, MAX(p_name) AS last_name FROM {part} GROUP BY p_brand",
    "agg_global": "SELECT COUNT(*) AS n, ROUND(SUM(value), 2) AS total, MIN(value) AS least, MAX(value) AS most FROM {events} WHERE event_type = 'no such type'",
    "group_any_value": "SELECT p_brand, COUNT(*) AS n, MIN(p_name) AS any_name FROM {part} GROUP BY p_brand",
    "having_agg": "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 12 AND NOT (SUM(o_totalprice) < 1000000)",
    "having_alias": "SELECT p_brand, COUNT(*) AS cnt FROM {part} GROUP BY p_brand HAVING cnt >= 80 OR cnt < 70",
    "distinct_cols": "SELECT DISTINCT p_brand, p_type FROM {part}",
    "distinct_expr": "SELECT DISTINCT p_size % 7 AS bucket, p_size * 2 > 50 AS large FROM {part}",
    # order and limit
    "order_multi": "SELECT c_custkey, c_mktsegment, c_acctbal FROM {customer} ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey",
    "order_ordinal": "SELECT n_regionkey, n_name FROM {nation} ORDER BY 1 DESC, 2",
    "order_computed": "SELECT p_partkey, p_retailprice - p_size * 10 AS margin FROM {part} ORDER BY margin DESC, p_partkey",
    "order_hidden": "SELECT p_name FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
    "limit_rows": "SELECT o_orderkey FROM {orders} LIMIT 0",
    "topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    # CTEs and derived tables
    "cte_chain": """WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS customers FROM a GROUP BY n)
        SELECT n, customers FROM b WHERE customers > 5""",
    "cte_shadow": "WITH orders AS (SELECT n_nationkey, n_name FROM {nation} WHERE n_regionkey = 2) SELECT n_nationkey, n_name FROM orders",
    "derived_nested": """SELECT y.o_orderstatus, y.n FROM (SELECT x.o_orderstatus, COUNT(*) AS n FROM
        (SELECT o_orderstatus, o_totalprice FROM {orders} WHERE o_totalprice > 50000) x GROUP BY x.o_orderstatus) y WHERE y.n > 10""",
    # expressions
    "expr_concat": "SELECT c_custkey, c_name || ':' || c_mktsegment AS label, c_name || NULLIF(c_mktsegment, 'BUILDING') AS maybe FROM {customer}",
    "expr_case": """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size,
        CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code, o_totalprice > 150000 AS rich FROM {orders}""",
    "expr_coalesce": """SELECT d.doc_id, COALESCE(l.quality, -1) AS quality, COALESCE(NULLIF(d.lang, 'en'), l.toxic || '', 'none') AS tag
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "expr_cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS key_text, CAST(FLOOR(o_totalprice) AS BIGINT) AS whole FROM {orders}",
    "expr_predicates": """SELECT p_partkey, p_name LIKE '%a%' AS has_a, p_type ILIKE 'promo%' AS promo, p_size IN (1, 2, 3) AS tiny,
        NULLIF(p_brand, 'Brand#11') IS NULL AS brand11, p_size BETWEEN 10 AND 20 AS mid FROM {part}""",
    # roll-ups on plain columns
    "arch_languages": "SELECT lang AS language, COUNT(DISTINCT source || '/' || doc_id) AS files FROM {documents} GROUP BY lang",
}

#: As BOTH, where the engines' dialects differ: (Spark, DuckDB).
EACH: dict[str, tuple[str, str]] = {
    "expr_arith": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -l_quantity AS neg, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / (l_linenumber - 1) AS per_line FROM {lineitem}",
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -l_quantity AS neg, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / NULLIF(l_linenumber - 1, 0) AS per_line FROM lineitem",
    ),
    "json_metadata": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, to_json(named_struct('type', event_type, 'user', user_id)) AS meta FROM {events}",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(to_json({'type': event_type, 'user': user_id}) AS VARCHAR) AS meta FROM events",
    ),
}


def lookup_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-key lookup as a semi join with the key table."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(keys, orders["o_orderkey"] == keys["k"], "left_semi").select("o_orderkey", "o_totalprice")


def _names(text: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in text]


def _query(text: str):
    """The statement through the SQL front end; ``o.o_orderkey`` is called o_orderkey, as other engines do."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(spark, {n: table(spark, sf_dir, n) for n in _names(text)}).frame(plain(text))
        return df.toDF(*[c.rpartition(".")[2] for c in df.columns])

    return run


def plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


QUERIES = {k: _query(v) for k, v in BOTH.items()} | {k: _query(v[0]) for k, v in EACH.items()} | {"lookup_by_keys": lookup_by_keys}
SQL = {k: plain(v) for k, v in BOTH.items()} | {k: v[1] for k, v in EACH.items()} | {"lookup_by_keys": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT s_suppkey FROM supplier)"}
