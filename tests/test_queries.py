"""Every registered query of the reference's operators against its SQL, over whole tables."""

import pytest

from graphloom.plans import catalogue

from . import oracle
from .conftest import DATA

SF = f"{DATA}/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
