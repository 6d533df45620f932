"""Every registered query against DuckDB on the same tables."""

import pytest
from conftest import assert_same

from lodeworks.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_duckdb(key, spark, sf_dir, duck):
    assert_same(registry.queries()[key](spark, sf_dir), duck, SQL[key])


@pytest.mark.parametrize("key", sorted(registry.queries().keys() - SQL.keys()))
def test_query_without_oracle_has_rows(key, spark, sf_dir):
    assert registry.queries()[key](spark, sf_dir).count() > 0


def test_entry_is_importable(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_one_operator(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(registry.queries()["topk"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan_of(registry.queries()["vector_topk"](spark, sf_dir))


@pytest.mark.parametrize("key", ["join_comma_equi", "join_like_prefix", "join_three_way", "coupling_matrix", "component_longest_prefix"])
def test_equi_joins_make_no_product(key, spark, sf_dir):
    plan = plan_of(registry.queries()[key](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hops_are_hash_joins(spark, sf_dir):
    """From a table of starts; a constant start becomes a filter instead."""
    from lodeworks.operators import graph
    from lodeworks.sources import star

    starts = star.symbols(spark, sf_dir).where("kind = 'Customer'").select("id")
    plan = plan_of(graph.trace(star.relationships(spark, sf_dir), starts, "upstream", 3))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(registry.queries()["scan_filter"](spark, sf_dir))
    assert "GreaterThanOrEqual(p_size,40)" in plan and "p_retailprice" not in plan
