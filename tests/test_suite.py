"""Every query of the mail engine against its SQL."""

import pytest
from compare import differences

from postsieve.plans.ongoing import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert not differences(QUERIES[name](spark, SF), ORACLES[name], SF)
