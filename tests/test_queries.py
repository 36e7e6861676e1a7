import os

import pytest

from lociflow import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_gives_what_sql_gives(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SF), duck(SF, queries.SQL[name]))


def test_entry_has_a_row_for_each_pixel(spark):
    assert queries.entry(spark, SF).count() == 400
