from __future__ import annotations

from tests.conftest import tuples
from textmine.operators import counts, tokens
from textmine.plans.jobs import corpus_totals, initial_letter_counts


def test_corpus_totals(headlines, spark):
    assert tuples(corpus_totals(headlines)) == [("chars", 448), ("lines", 9), ("words", 49)]
    empty = spark.createDataFrame([], "value string")
    assert tuples(corpus_totals(empty)) == [("chars", 0), ("lines", 0), ("words", 0)]


def test_characters_are_code_points(spark):
    lines = spark.createDataFrame([("né 😀",), ("",)], "value string")
    assert dict(tuples(corpus_totals(lines))) == {"chars": 4, "words": 2, "lines": 2}


def test_initial_letters(headlines):
    letters = tuples(initial_letter_counts(headlines))
    assert len(letters) == 16 and letters == sorted(letters)
    assert {("c", 8), ("s", 6), ("e", 5)} <= set(letters)


def test_initial_letters_are_lowered_and_alphabetic(spark):
    lines = spark.createDataFrame([(" Ab 1x _y Éa éb\tÄ",)], "value string")
    assert tuples(initial_letter_counts(lines)) == [("a", 1), ("ä", 1), ("é", 2)]


def test_term_counts(spark):
    rows = [("x", ["a", "b", "a", ""]), ("y", ["a"]), ("y", []), ("z", None)]
    df = spark.createDataFrame(rows, "period string, words array<string>")
    assert sorted(tuples(counts.term_counts(df))) == [("a", 3), ("b", 1)]
    assert sorted(tuples(counts.term_period_counts(df))) == [
        ("a", "x", 2),
        ("a", "y", 1),
        ("b", "x", 1),
    ]
    assert sorted(tuples(counts.period_frequency(df))) == [("a", 2), ("b", 1)]


def test_stopword_forms_agree(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["b"],)], "words array<string>")
    terms = tokens.explode_terms(df)
    frame = spark.createDataFrame([("b",), ("b",), ("q",)], "word string")
    listed = sorted(tuples(tokens.drop_stopwords(terms, ["b", "q"])))
    assert listed == sorted(tuples(tokens.drop_stopwords(terms, frame))) == [("a",), ("a",), ("c",)]
    assert tokens.drop_stopwords(terms, []) is terms


def test_tokenizing_happens_once(spark, tmp_path):
    """No filter derived from the explode repeats the split below the projection."""
    path = str(tmp_path / "t")
    spark.createDataFrame([("a b",)], "value string").write.parquet(path)
    counted = counts.term_counts(tokens.with_words(spark.read.parquet(path)))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(value") == 1
