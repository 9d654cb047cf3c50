"""Every query against its SQL, on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tidewire.plans import catalog, desk_catalog, extraction_catalog, newsroom_catalog, report_catalog, service_catalog, stream_catalog, tick_catalog  # noqa: F401

from .compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_match_the_sql(spark, con, name):
    n, some, expected, same = differences(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert same, (n, expected, some)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
