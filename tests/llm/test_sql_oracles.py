import pytest
from bytestrata.llm.queries import ORACLES, QUERIES

from tests.oracle import compare


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name, sf):
    compare(spark, f"/root/testdata/{sf}", QUERIES[name], ORACLES[name])
