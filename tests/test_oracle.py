import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    assert check.difference(got, duck.execute(entry.oracle_sql()[name]).to_arrow_table()) is None


def test_entry(spark):
    assert "novelty" in entry.entry(spark).columns
