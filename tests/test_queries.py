import pytest

from brindle.plans.registry import ORACLES, QUERIES
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
