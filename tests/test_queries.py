"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal_to_sql(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, duck.execute(contract.oracle_sql()[name]).df()) is None


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["term", "period", "tf", "df", "weight"]
    assert result.count() > 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(contract.queries())
