"""Every registered query against its SQL on the smallest tables."""

import pytest

from kindred.plans import catalogue
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(catalogue.QUERIES[name](spark, FOLDER), catalogue.ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["a", "b", "diff"]


def test_band_join_is_an_equi_join(spark):
    df = catalogue.QUERIES["duration_band_join"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
