from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 8


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    outcome = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert outcome.startswith(("ok", "rows only")), outcome
