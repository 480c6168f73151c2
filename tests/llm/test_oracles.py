from __future__ import annotations

import pytest
from check_queries import compare, duck

from sillage.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("key", ORACLES)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(shipped, key, sf):
    folder = f"/root/testdata/{sf}"
    assert compare(QUERIES[key](shipped, folder), duck(folder), ORACLES[key]) == []
