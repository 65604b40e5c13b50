"""Rules for lists, nulls and intermediate tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from textmine.functions.text import term_bag
from textmine.operators import tokens
from textmine.operators.cooccurrence import bag_pairs, with_bags
from textmine.operators.counts import corpus_totals
from textmine.operators.ranking import rarity_sorted
from textmine.operators.setjoin import expand, similar_sets
from textmine.plans.jobs import tfidf_lines
from textmine.sources.lines import parse_dated_lines
from textmine.sources.scratch import intermediate_tables, materialize

from .conftest import tuples

ROWS = [
    (1, ["b", "the", "a", "b", "of"]),
    (2, ["the", "of", "the"]),
    (3, []),
    (4, None),
    (5, ["z", "the", "y", "x"]),
]


@pytest.mark.parametrize("limit", [1, 5000])
@pytest.mark.parametrize("form", ["list", "generator", "frame"])
def test_stop_words_mean_the_same_at_every_length(spark, monkeypatch, limit, form):
    monkeypatch.setattr(tokens, "MAX_INLINE_STOPWORDS", limit)
    df = spark.createDataFrame(ROWS, "id int, words array<string>")
    stop = ["the", None, "of"]
    if form == "frame":
        stop = spark.createDataFrame([(w,) for w in stop], "word string")
    elif form == "generator":
        stop = (w for w in ["the", None, "of"])
    got = dict(map(tuple, tokens.clean_words(df, ["id"], stopwords=stop).collect()))
    assert got == {1: ["b", "a", "b"], 2: [], 3: [], 4: None, 5: ["z", "y", "x"]}


def test_null_words_and_lines(spark):
    df = spark.createDataFrame([(["a", None, "b"],), ([None],)], "words array<string>")
    bags = [r[0] for r in df.select(term_bag(F.col("words"))).collect()]
    assert [[tuple(e) for e in b] if b else b for b in bags] == [[("a", 1), ("b", 1)], None]
    lines = spark.createDataFrame([("x y",), (None,)], "value string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        totals = dict(map(tuple, corpus_totals(lines).collect()))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert totals == {"chars": 3, "words": 2, "lines": 2}


def test_pieces_of_repeated_lines_are_dealt_evenly(spark):
    rows = [(["w", "v"],)] * 400 + [(None,)] * 400 + [([f"a{i}", f"b{i}"],) for i in range(400)]
    bags = with_bags(spark.createDataFrame(rows, "words array<string>"), [])
    pairs = bag_pairs(bags, [], spread=8)
    sizes = [r[1] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    # The 400 equal lines are one row that counts 400.
    assert sum(sizes) == 401 and max(sizes) < 2 * min(sizes)
    assert pairs.agg(F.sum("n")).head()[0] == 800


def test_copies_in_one_period_make_no_cells(spark):
    rows = [(i, "a", ["x", "y"]) for i in range(300)] + [(999, "b", ["x", "y"])]
    df = spark.createDataFrame(rows, "id long, period string, words array<string>")
    out = expand(similar_sets(df, 1.0), block=8)
    assert out.count() == 300
    assert out.where("id2 = 999").count() == 300
    every = expand(similar_sets(df.limit(40), 1.0, cross_period=False), cross_period=False, block=8)
    assert every.count() == 40 * 39 // 2


def test_ranking_reads_its_input_once(spark):
    df = spark.createDataFrame([(1, "p", ["b", "a"]), (2, "p", ["a"])], "id int, period string, words array<string>")
    out = rarity_sorted(df)
    assert sorted(tuples(out)) == [(1, "p", ["b", "a"]), (2, "p", ["a"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_intermediate_tables_go(spark):
    with intermediate_tables(spark):
        kept = materialize(spark.range(3), "probe")
        path = kept.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        assert os.path.isdir(path.replace("//", "/"))
    assert not os.path.isdir(path.replace("//", "/"))


def test_period_of_a_short_first_field(spark):
    lines = spark.createDataFrame([("99,aa bb",), ("20200101,cc",)], "value string")
    by = {p: [r["period"] for r in parse_dated_lines(lines, period_from=p).collect()] for p in ("line", "field")}
    assert by == {"line": ["99,a", "2020"], "field": ["99", "2020"]}


def test_large_weights_are_plain_decimals(spark):
    rows = [("a", "p", 12345678.5), ("b", "p", 30000000.0), ("c", "p", 1.25)]
    lines = tfidf_lines(spark.createDataFrame(rows, "term string, period string, weight double"))
    texts = [r["output"].partition("\t")[2] for r in lines.collect()]
    assert texts == ['"p,12345678.5"', '"p,30000000.0"', '"p,1.25"']


def test_only_places_of_stop_words_move(spark, monkeypatch):
    """A long list costs what it drops: the words kept are cut from the row, not put together."""
    monkeypatch.setattr(tokens, "MAX_INLINE_STOPWORDS", 1)
    rows = [
        (1, ["a", "b", "a", "c", "c", "a"]),
        (2, ["b", "c", "b"]),
        (3, ["a", None, "b", "a"]),
        (4, ["b", "b", "c"]),
        (5, []),
        (6, None),
        (7, ["x", "y"]),
    ]
    df = spark.createDataFrame(rows, "id int, words array<string>")
    for stop in (["b", "c", "q", None], spark.createDataFrame([("b",), ("c",), (None,), ("q",)], "w string")):
        cleaned = tokens.clean_words(df, ["id"], stopwords=stop)
        assert dict(map(tuple, cleaned.collect())) == {
            1: ["a", "a", "a"], 2: [], 3: ["a", "a"], 4: [], 5: [], 6: None, 7: ["x", "y"]
        }
        plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(_at" in plan and "collect_list(struct" not in plan
