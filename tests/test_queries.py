"""Every query of the catalog against its SQL."""

from __future__ import annotations

import pytest
from check_queries import compare

import __spark_entry__ as entry
from sillage.catalog import ORACLES, QUERIES

@pytest.mark.parametrize("key", ORACLES)
def test_query_equals_sql(spark, duck, sf_dir, key):
    problems = [p for p in compare(QUERIES[key](spark, sf_dir), duck, ORACLES[key]) if p != "EMPTY"]
    assert problems == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_the_catalog_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rang", "departement", "region", "n0", "n1", "delta_pct", "part_pct"]
    assert df.count() > 0
