import pytest

from claimweave import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, oracle, rows_of, sf, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf)) == oracle(catalogue.SQL[name])


def test_others_run(spark, sf):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
