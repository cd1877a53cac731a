import pytest

from lodestone import registry
from tests.support import SMALL, assert_equal


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_equal(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["vec_id", "score"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_is_planned_without_a_full_sort(spark):
    from lodestone.queries import vectors

    plan = vectors.semantic_search_ranked(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema" in plan
