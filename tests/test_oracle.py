"""A few registered queries against their SQL; ``python tests/oracle.py`` compares all of them."""

import pytest

from polisframe.plans import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["flagship", "path_shared_supplier", "positional_step", "sort_two_keys", "tile_type_counts",
                                  "feature_count_by_lod_active", "lod_filter_and_depth1", "delete_log", "changes_combined",
                                  "s_overlaps_diamond"])
def test_query(spark, con, name):
    assert compare(con, ORACLE[name], QUERIES[name](spark, SF)) == ""
