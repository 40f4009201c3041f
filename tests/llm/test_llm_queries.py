"""Every query of the subpackage runs on the smallest tables, and equals its SQL where it has one."""

import pytest

from lexloom.llm import queries as Q
from tests.conftest import DATA, compare

ALL, SQL = Q.queries(), Q.oracle_sql()


@pytest.mark.parametrize("part", range(3))
def test_against_sql(spark, part):
    assert compare(spark, ALL, SQL, sorted(SQL)[part::3]) == []


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, DATA).count() > 0
