import pytest

from docspark import registry


@pytest.mark.parametrize(
    ("name", "table", "key"),
    [("inc_array_parts", "lineitem", "l_orderkey"), ("arith_precedence", "lineitem", None), ("arith_date_ticks", "orders", None)],
)
def test_covers_its_table(name, table, key, spark, data):
    rows = spark.read.parquet(f"{data}/{table}.parquet")
    assert registry.QUERIES[name](spark, data).count() == (rows.select(key).distinct() if key else rows).count()
    assert " where " not in registry.ORACLE_SQL[name]
