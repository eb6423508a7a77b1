"""Every query against its SQL, on the smallest tables."""

import pytest

from lectern.plans.registry import ORACLES, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert check(df, ORACLES[name], sf_dir) > 0
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
