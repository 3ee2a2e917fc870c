"""Every query beside its SQL, at the smallest scale."""

import pytest

from gaugeframe.plans import queries

from .compare import connect, differ

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, con, name):
    assert differ(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
    for name in ("confusables", "nms_regions", "absorb_fragments", "segment_pages"):
        assert e.queries()[name](spark, SF).count() > 0
