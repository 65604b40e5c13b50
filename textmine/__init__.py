"""Text mining on Spark DataFrames."""

from textmine.functions.text import tokenize
from textmine.plans.jobs import (
    corpus_totals,
    directional_cooccurrence,
    initial_letter_counts,
    jaccard_self_join,
    tfidf_by_period,
    top_pairs_by_period,
)
from textmine.sources.lines import parse_dated_lines, read_lines, read_stopwords, write_lines

__all__ = [
    "corpus_totals",
    "directional_cooccurrence",
    "initial_letter_counts",
    "jaccard_self_join",
    "parse_dated_lines",
    "read_lines",
    "read_stopwords",
    "tfidf_by_period",
    "tokenize",
    "top_pairs_by_period",
    "write_lines",
]
