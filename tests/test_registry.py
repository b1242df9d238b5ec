"""Every registered query against its DuckDB text at the smallest scale."""

import pytest

from checks.compare import connect, differences
from checks.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small_sf):
    return connect(small_sf)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {
        "forest_predictions", "forest_importance", "forest_reload", "forest_info", "oof_r2"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, small_sf, name):
    assert differences(QUERIES[name](spark, small_sf), duck, ORACLES[name]) == []


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() == 10 and "grid_entropy" in rows.columns
    assert entry.queries().keys() >= entry.oracle_sql().keys()
