"""The registered queries on the smallest tables: against SQL where there is one, and repeated runs agree."""

import pytest

from kindred.llm import queries
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), queries.ORACLE_SQL[name], FOLDER)


def test_mixing_reruns_agree(spark):
    a, b = (sorted(map(tuple, queries.QUERIES["op5_mix_sources"](spark, FOLDER).collect())) for _ in range(2))
    assert a == b and len(a) == 200
