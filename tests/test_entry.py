import __spark_entry__ as entry
from prunella import catalog


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
