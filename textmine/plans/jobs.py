"""The six text-mining jobs, DataFrame in and DataFrame out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.functions.text import json_kv_line, strip, tokenize
from textmine.operators import setjoin
from textmine.operators.cooccurrence import count_pairs, directional_counts, with_bags
from textmine.operators.counts import (
    corpus_totals,
    initial_letter_counts,
    term_and_period_counts,
    term_period_counts,
)
from textmine.operators.promising import pair_order, promising_pairs
from textmine.operators.tokens import clean_words
from textmine.operators.topk import top_k_per_group
from textmine.operators.weights import tfidf

__all__ = [
    "corpus_totals",
    "directional_cooccurrence",
    "initial_letter_counts",
    "jaccard_self_join",
    "tfidf_by_period",
    "tfidf_lines",
    "top_pairs_by_period",
]


def tfidf_by_period(
    df: DataFrame,
    *,
    n_periods: int | None = None,
    beta: float | None = None,
    sort: bool = True,
) -> DataFrame:
    """``<term, period, tf, df, weight>`` from ``<period, words>``.

    ``n_periods`` defaults to the number of different periods of ``df``, which
    includes those of records without words and comes from the same reading of the
    text. Rows with a weight below ``beta`` are left out. Ordered by term, then
    period descending.
    """
    if n_periods is None:
        weighted = tfidf(*term_and_period_counts(df))
    else:
        weighted = tfidf(term_period_counts(df), n_periods)
    if beta is not None:
        weighted = weighted.where(F.col("weight") >= beta)
    weighted = weighted.select("term", "period", "tf", "df", "weight")
    return weighted.orderBy("term", F.desc("period")) if sort else weighted


def tfidf_lines(weighted: DataFrame) -> DataFrame:
    """``"term" TAB "period,weight"``, one string column; large weights as plain decimals."""
    shortest = F.col("weight").cast("string")
    plain = F.regexp_replace(shortest.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    weight = F.when(F.col("weight") >= 1e7, plain).otherwise(shortest)
    value = F.concat_ws(",", "period", weight)
    return weighted.select(json_kv_line(F.col("term"), value).alias("output"))


def top_pairs_by_period(
    df: DataFrame,
    k: int,
    *,
    stopwords: DataFrame | Iterable[str] | None = None,
    keys: Sequence[str] = ("period",),
    spread: int | None = None,
    prune: bool = True,
    sort: bool = True,
) -> DataFrame:
    """``<period, term1, term2, n>``: the ``k`` most frequent pairs of each period.

    Stop words and words that do not start with a to z are left out. Pairs are
    unordered, term1 <= term2; equal counts rank by term1, term2. ``prune`` leaves
    out, before pairs are counted, what cannot be among the first ``k``: the same
    result from far fewer pairs. It writes intermediate tables when it is called;
    without it every pair is counted, and nothing runs before an action. ``spread``
    deals pieces of lines out over so many partitions.
    """
    cleaned = clean_words(df, keys, stopwords=stopwords, lowercase_initial=True)
    bags = with_bags(cleaned, keys)
    if prune:
        pairs = promising_pairs(bags, keys, k, spread=spread)
        counted = pairs.groupBy(*keys, "term1", "term2").agg(F.sum("n").alias("n"))
    else:
        counted = count_pairs(bags, keys, spread=spread)
    top = top_k_per_group(counted, keys, pair_order(), k)
    return top.orderBy(*keys, *pair_order()) if sort else top


def directional_cooccurrence(
    lines: DataFrame,
    *,
    value: str = "value",
    keys: Sequence[str] = (),
    spread: int | None = None,
    sort: bool = True,
) -> DataFrame:
    """``<keys..., term, other, n>``: lower-cased terms of the same line, both directions."""
    text = F.lower(strip(F.col(value)))
    words = lines.select(*keys, tokenize(text, "punct").alias("words"))
    return directional_counts(words, keys=keys, spread=spread, sort=sort)


def jaccard_self_join(
    df: DataFrame, tau: float, *, cross_period: bool = True, sort: bool = True
) -> DataFrame:
    """``<id1, id2, sim>``: record pairs with Jaccard similarity >= ``tau``.

    ``df`` is ``<id, period, words>`` with unique ids that do not change when it
    is read again. With ``cross_period`` only pairs of different periods count.
    Use :func:`textmine.operators.setjoin.similar_sets` for the compact form,
    which does not write out the pairs within and between groups of copies.
    """
    similar = setjoin.similar_sets(df, tau, cross_period=cross_period)
    # Sorting samples its input first; written, what is joined is evaluated once.
    pairs = setjoin.expand(similar, cross_period=cross_period, written=sort)
    return pairs.orderBy("id1", "id2") if sort else pairs
