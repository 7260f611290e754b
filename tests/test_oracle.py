"""Every registered query against its DuckDB text on the smallest tables."""

import pytest

from signalframe.plans import QUERIES
from tests.oracle import ROOT, compare, connect

SF = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, QUERIES[name], SF) == ""


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
