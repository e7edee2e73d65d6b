import os

import pytest

from lakelens.plans import catalog
from tests.differential import by_spark, by_sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert by_spark(catalog.QUERIES[name](spark, FOLDER)) == by_sql(catalog.SQL[name], FOLDER)
