"""Every registered query against its SQL, on whole tables."""

import pytest

from compare import diff, duck
from pkgatlas.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert diff(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "name" and len(df.collect()) <= 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
