"""Registered queries over the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from checks.compare import connect
from textmine.llm.oracles import ORACLES
from textmine.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, name):
    got = contract.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = connect(FOLDER).sql(contract.oracle_sql()[name]).select(", ".join(columns))
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert rows == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["op5_decontaminate", "op8_token_counts", "op9_quality"])
def test_runs_over_the_whole_table(spark, name):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = contract.queries()[name](spark, FOLDER)
    if name == "op9_quality":
        assert got.count() == documents.count()
    elif name == "op8_token_counts":
        total = got.selectExpr("sum(docs)").first()[0]
        assert total == documents.select("text").distinct().count()
    else:
        found = got.join(documents, "doc_id", "left_anti").count()
        assert got.count() and not found
