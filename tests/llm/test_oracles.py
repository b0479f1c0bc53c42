import pytest

from tests.compare import same
from wayfold.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert same(QUERIES[name](spark, sf), ORACLES[name], sf) > 0
