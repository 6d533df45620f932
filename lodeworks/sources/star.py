"""The star schema read as a code base: entities are symbols, foreign keys are edges.

Regions, nations, suppliers, customers and parts become symbols whose file path is
their place (region/nation/name) and whose full name is dotted accordingly; orders
place, contain and ship by edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import run_sql

SYMBOLS_SQL = """
SELECT 'r:' || r_regionkey AS id, r_name AS name, 'Region' AS kind, r_name AS file_path, r_name AS full_name FROM {region}
UNION ALL SELECT 'n:' || n_nationkey, n_name, 'Nation', r_name || '/' || n_name, r_name || '.' || n_name
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 's:' || s_suppkey, s_name, 'Supplier', r_name || '/' || n_name || '/' || s_name, r_name || '.' || n_name || '.' || s_name
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'c:' || c_custkey, c_name, 'Customer', r_name || '/' || n_name || '/' || c_name, r_name || '.' || n_name || '.' || c_name
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'p:' || p_partkey, p_name || p_partkey, 'Part', p_brand || '/' || p_name || p_partkey, p_brand || '.' || p_name || p_partkey FROM {part}
"""

EDGES_SQL = """
SELECT source_symbol_id || '->' || target_symbol_id || ':' || relationship_type AS id, source_symbol_id, target_symbol_id, relationship_type FROM (
  SELECT 'c:' || o_custkey AS source_symbol_id, 'o:' || o_orderkey AS target_symbol_id, 'Places' AS relationship_type FROM {orders}
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'Contains' FROM {lineitem}
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 's:' || l_suppkey, 'ShippedBy' FROM {lineitem}
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'In' FROM {supplier}
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'In' FROM {nation}) e
"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, SYMBOLS_SQL, ["region", "nation", "supplier", "customer", "part"])


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, EDGES_SQL, ["orders", "lineitem", "supplier", "nation"])
