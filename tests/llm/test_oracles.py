"""Queries of the llm folder that have SQL, on the smallest tables."""

import os

import pytest

from quernel.llm import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    oracle.compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
