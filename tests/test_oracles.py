"""Every query against its SQL on the smallest tables."""

import os

import pytest

from quernel.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    oracle.compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_entry_point_lists_all():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
