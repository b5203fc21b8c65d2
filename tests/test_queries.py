import pytest

import __spark_entry__ as entry
from sleuthwork.plans import queries as engine
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_matches_sql(spark, sf, name):
    same(spark, sf, name, engine.QUERIES, engine.SQL)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_runs(spark, sf, name):
    assert engine.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rejection" in df.columns


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
