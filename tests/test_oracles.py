import pytest

from oracle import same
from pagelore import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    assert same(registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name])) > 0


def test_every_query_runs(spark, sf_dir):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
