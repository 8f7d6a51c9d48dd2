"""Every query with SQL gives the SQL's rows, columns and types."""

import pytest
from oracle import compare

from catalog import ORACLES, QUERIES


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) == ""
