"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    return compare.connect(SF_DIR)


def test_registration():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 120


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name in ORACLES:
        assert compare.difference(got, sql.execute(ORACLES[name]).df()) is None
    else:
        assert len(got) > 0
