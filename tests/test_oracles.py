"""Every registered retail query equals its SQL twin on the smallest tables."""

import pytest

from promolens import plans
from tests.conftest import SF, same_rows

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(plans.queries()[name](spark, SF), duck.sql(SQL[name]))


def test_queries_without_sql_run(spark):
    for name in set(plans.queries()) - set(SQL):
        assert plans.queries()[name](spark, SF).columns
