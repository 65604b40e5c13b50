from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import tuples
from textmine.functions.text import (
    id_pair_line,
    json_kv_line,
    keep_words,
    kv_line,
    period_pair_line,
    strip,
    term_bag,
    tokenize,
)


def one(spark, column, value):
    df = spark.createDataFrame([(value,)], "value string")
    return df.select(column(F.col("value"))).head()[0]


@pytest.mark.parametrize(
    ("mode", "text", "words"),
    [
        ("space", "a  b ", ["a", "b"]),
        ("space", "", []),
        ("space", "a\tb c", ["a\tb", "c"]),
        ("whitespace", " a\t b c\x1cd\x85e\n", ["a", "b", "c", "d", "e"]),
        ("tfidf", "a,b; c\td e;f", ["a", "b", "c", "d", "e;f"]),
        ("punct", "it's a-b_c (d) [e] {f} <g> ~h x@y z=1 p|q", None),
        ("letters", "abc1déf, gh", ["abc", "déf", "gh"]),
    ],
)
def test_tokenize(spark, mode, text, words):
    if words is None:
        words = "it s a b c d e f g h x@y z=1 p|q".split(" ")
    assert one(spark, lambda c: tokenize(c, mode), text) == words


def test_punctuation_class(spark):
    delimiters = " *$&#/\t\n\f\"',.:;?![](){}<>~-_"
    kept = "@%+=^|`\\"
    text = "".join(f"w{d}" for d in delimiters) + "".join(f"v{d}" for d in kept)
    words = one(spark, lambda c: tokenize(c, "punct"), text)
    assert words == ["w"] * len(delimiters) + ["".join(f"v{d}" for d in kept)]


def test_unknown_tokenizer():
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tokenize(None, "sentences")


def test_strip(spark):
    assert one(spark, strip, "  \ta b\x1f\r\n") == "a b"


def test_keep_words(spark):
    df = spark.createDataFrame([(["The", "the", "cat", "9x", "cat", "émile"],)], "words array<string>")
    kept = keep_words(F.col("words"), lowercase_initial=True, stopwords=["the"])
    assert df.select(kept).head()[0] == ["cat", "cat"]


@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é", "Z", "z "])), min_size=1))
@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
def test_term_bag_is_a_sorted_counter(spark, lists):
    rows = list(enumerate(lists))
    df = spark.createDataFrame(rows, "id int, words array<string>")
    for i, bag in tuples(df.select("id", term_bag(F.col("words")))):
        want = sorted(Counter(lists[i]).items(), key=lambda e: e[0].encode())
        assert [tuple(e) for e in bag or []] == want


def test_term_bag_of_null(spark):
    df = spark.createDataFrame([(None,)], "words array<string>")
    assert df.select(term_bag(F.col("words"))).head()[0] is None


def test_formats(spark):
    df = spark.createDataFrame([("2003", "a", "b", 2, 0, 7, 0.125)], "p string, a string, b string, n bigint, i bigint, j bigint, s double")
    row = df.select(
        period_pair_line(F.col("p"), F.col("a"), F.col("b"), F.col("n")),
        id_pair_line(F.col("i"), F.col("j"), F.col("s")),
        kv_line(F.col("a"), F.col("n")),
        json_kv_line(F.lit('say "x"'), F.concat_ws(",", "p", F.col("s").cast("string"))),
    ).head()
    assert tuple(row) == (
        "2003    a,b:2",
        "(0,7)    0.125",
        "a 2",
        '"say \\"x\\""\t"2003,0.125"',
    )
