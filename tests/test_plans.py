"""Physical plans of representative queries: what must not grow with the data."""

import pytest

from docspark import registry


def plan(spark, data, name):
    return registry.QUERIES[name](spark, data)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["flt_and_or", "flt_any_gt", "seq_map", "fn_str_lower", "proj_doc", "seq_sort"])
def test_narrow_queries_do_not_shuffle(spark, data, name):
    assert "Exchange" not in plan(spark, data, name).split("Physical Plan")[1]


@pytest.mark.parametrize("name", ["agg_basic", "agg_map_sum", "grp_flag", "grp_having", "grp_array_sum", "agg_nested_array"])
def test_aggregates_are_partial_first_and_never_collect(spark, data, name):
    physical = plan(spark, data, name).split("Physical Plan")[1]
    assert "partial_" in physical and "collect_list" not in physical and "Generate" not in physical


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_and_no_cross_joins(spark, data, name):
    if name.startswith(("dml", "ddl", "into", "src_file")):
        pytest.skip("writes first")
    physical = plan(spark, data, name).split("Physical Plan")[1]
    assert not any(x in physical for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
