"""Queries of the training-data operators against their SQL."""

import pytest
from compare import differences

from postsieve.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, name, size):
    sf = f"/root/testdata/{size}"
    assert not differences(QUERIES[name](spark, sf), ORACLES[name], sf)
