import pytest

from docspark import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, data, same_as_oracle):
    if name in registry.ORACLE_SQL:
        same_as_oracle(registry.QUERIES[name], registry.ORACLE_SQL[name])
    else:
        assert registry.QUERIES[name](spark, data).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
