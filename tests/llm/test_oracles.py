import pytest

from gaugeframe.llm import queries

from ..compare import connect, differ

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, name):
    assert differ(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) is None
