"""Every registered query against its check SQL, on the smallest tables."""

import pytest

from __spark_entry__ import SMALL, entry, oracle_sql, queries
from compare import check_database, differences
from tocsin.plans.queries import registered

ALL, CHECKS = queries(), oracle_sql()


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_of_the_package_has_a_check():
    assert set(registered()) <= set(CHECKS)
    assert set(CHECKS) <= set(ALL)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, name):
    assert differences(ALL[name](spark, SMALL), check_database(SMALL), CHECKS[name]) == []
