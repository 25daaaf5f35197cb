"""Every query against its SQL."""

import pytest
from conftest import DATA

from gazette.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001"), ORACLE_SQL[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
