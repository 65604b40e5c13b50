"""Counting terms, letters, words and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmine.functions.text import strip, tokenize
from textmine.operators.tokens import explode_terms, keep_alphabetic


def term_counts(df: DataFrame, *, words: str = "words") -> DataFrame:
    """``<term, n>``: occurrences of each term."""
    return explode_terms(df, words=words).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_period_counts(
    df: DataFrame, *, period: str = "period", words: str = "words"
) -> DataFrame:
    """``<term, period, tf>``: occurrences of each term in each period."""
    return (
        explode_terms(df, period, words=words)
        .groupBy("term", period)
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_and_period_counts(
    df: DataFrame, *, period: str = "period", words: str = "words"
) -> tuple[DataFrame, DataFrame]:
    """``<term, period, tf>``, and the number of periods as a one-row frame, from one reading.

    Records without words stay in the count as rows with a tf of 0, so their periods
    are known after the shuffle. The rows without terms are told apart by that sum,
    not by the term, and both results use it: so both are the same up to the shuffle,
    and Spark reads and tokenizes the text once.
    """
    # Terms are never null, or the join on them would be given a filter of its own.
    term = F.coalesce("term", F.lit(""))
    everything = (
        df.select(period, F.explode_outer(words).alias("term"))
        .select(period, term.alias("term"))
        .groupBy("term", period)
        .agg(F.count_if(F.col("term") != "").alias("tf"))
    )
    per_period = everything.groupBy(period).agg(F.sum("tf").alias("uses"))
    n_periods = per_period.agg(
        F.count_if(F.col(period).isNotNull() & (F.col("uses") >= 0)).alias("n")
    )
    return everything.where(F.col("tf") > 0).select("term", period, "tf"), n_periods


def number_periods(periods: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``<period, number>``: dense numbers from 0; periods that are known keep theirs.

    Periods are few (years, days, sources), as in all of this library.
    """
    fresh = periods.select(F.col(periods.columns[0]).alias("period")).distinct()
    fresh = fresh.where(F.col("period").isNotNull())
    first = F.lit(0)
    if known is not None:
        fresh = fresh.join(known, "period", "left_anti")
        first = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).scalar()
    place = F.row_number().over(Window.orderBy("period"))
    numbered = fresh.select("period", (first + place - 1).cast("int").alias("number"))
    return numbered if known is None else known.select("period", "number").unionByName(numbered)


def period_bitmaps(term_periods: DataFrame, numbers: DataFrame) -> DataFrame:
    """``<term, word, bits: bigint>``: the periods of each term, 64 of them in a word.

    Words are combined inside the tasks with ``bit_or``, which works on plain longs in
    the hash aggregation; rows may repeat a (term, period).
    """
    numbered = term_periods.select("term", "period").join(numbers, "period")
    bit = F.expr("shiftleft(1L, number % 64)")
    return numbered.groupBy("term", F.expr("number div 64").cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )


def merge_period_bitmaps(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The bitmaps of several corpora or batches as one, without reading these again."""
    united = first
    for other in others:
        united = united.unionByName(other)
    return united.groupBy("term", "word").agg(F.bit_or("bits").alias("bits"))


def bitmap_frequency(bitmaps: DataFrame) -> DataFrame:
    """``<term, df>``: number of different periods with the term."""
    return bitmaps.groupBy("term").agg(F.sum(F.bit_count("bits")).alias("df"))


def period_frequency(
    df: DataFrame, *, period: str = "period", words: str = "words"
) -> DataFrame:
    """``<term, df>``: number of different periods with the term.

    Counts the (term, period) rows that are left after the occurrences have been
    added up, so a frequent term brings one row per period and not per use.
    """
    return (
        term_period_counts(df, period=period, words=words)
        .groupBy("term")
        .agg(F.count(period).alias("df"))
    )


def corpus_totals(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """``<metric, total>``: characters, white-space separated words, lines."""
    text = F.col(value)
    totals = lines.select(
        F.char_length(text).alias("chars"),
        F.coalesce(F.array_size(tokenize(text, "whitespace")), F.lit(0)).alias("words"),
    ).agg(
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.count(F.lit(1)).alias("lines"),
    )
    return totals.unpivot([], ["chars", "lines", "words"], "metric", "total")


def initial_letter_counts(
    lines: DataFrame, *, value: str = "value", sort: bool = True
) -> DataFrame:
    """``<letter, n>``: lower-cased words per first letter; other words are left out."""
    words = lines.select(tokenize(strip(F.lower(F.col(value))), "whitespace").alias("words"))
    counted = (
        keep_alphabetic(explode_terms(words))
        .groupBy(F.substring("term", 1, 1).alias("letter"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.orderBy("letter") if sort else counted
