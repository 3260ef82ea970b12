"""The registered queries on the small tables, against their SQL where there is one."""

import pytest

from foresail.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, same, name):
    assert same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name]) > 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
