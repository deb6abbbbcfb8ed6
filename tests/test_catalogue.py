import oracle
import pytest

from korrel import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert plans.queries().keys() == plans.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_rows_equal_the_sql(spark, con, name):
    oracle.same(plans.queries()[name](spark, SF), plans.oracle_sql()[name], con)
