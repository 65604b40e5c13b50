"""One query per operator, each over whole tables and whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.functions.text import (
    id_pair_line,
    keep_words,
    kv_line,
    period_pair_line,
    strip,
    tokenize,
)
from textmine.operators import cooccurrence, counts, ranking, setjoin, tokens
from textmine.operators.topk import top_k_per_group
from textmine.plans import jobs
from textmine.sources import lines as text_lines
from textmine.sources import tables
from textmine.sources.scratch import discard, materialize, scratch_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Words left out by the queries that take a list.
STOPWORDS = ["a", "and", "in", "is", "of", "on", "that", "the", "to", "with"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return text_lines.parse_dated_lines(tables.dated_lines(spark, folder), id_col="id")


def _common_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of every source, as a stop-word frame."""
    documents = tables.document_terms(spark, folder)
    sources = documents.agg(F.countDistinct("period").alias("n"))
    common = counts.period_frequency(documents).where(F.col("df") == sources.scalar())
    return common.select("term")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as records; the period is the role."""
    turns = tables.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return tables.deal_out(turns, "conv_id", "turn").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"),
        F.col("role").alias("period"),
        tokenize(F.lower("text"), "letters").alias("words"),
    )


def _weights(spark: SparkSession, folder: str, **options) -> DataFrame:
    weighted = jobs.tfidf_by_period(tables.document_terms(spark, folder), **options)
    return weighted.withColumn("weight", F.round("weight", 6))


# -- lines --------------------------------------------------------------------


@query
def parse_dated_lines(spark, folder):
    return _dated(spark, folder).withColumn("words", F.array_join("words", " "))


@query
def unparsed_lines(spark, folder):
    found = text_lines.unparsed_lines(tables.document_lines(spark, folder))
    return found.select("id", "value")


@query
def text_roundtrip(spark, folder):
    """Dated lines written as text files, read and parsed again."""
    path = f"{scratch_folder(spark)}/textmine-lines-{uuid.uuid4().hex}"
    text_lines.write_lines(tables.dated_lines(spark, folder).select("value"), path)
    parsed = text_lines.parse_dated_lines(text_lines.read_lines(spark, path))
    return parsed.select("period", F.array_join("words", " ").alias("words"))


@query
def stopword_file_roundtrip(spark, folder):
    """Stop words written as a text file, read and applied to the documents."""
    path = f"{scratch_folder(spark)}/textmine-stopwords-{uuid.uuid4().hex}"
    text_lines.write_lines(_common_terms(spark, folder), path, single_file=True)
    terms = tokens.explode_terms(tables.document_terms(spark, folder), "period")
    kept = tokens.drop_stopwords(terms, text_lines.read_stopwords(spark, path))
    return kept.groupBy("period").agg(F.count(F.lit(1)).alias("n"))


# -- tokens and filters -------------------------------------------------------


def _mode_counts(mode: str, lower: bool) -> Query:
    def run(spark, folder):
        lines = tables.document_lines(spark, folder)
        return counts.term_counts(tokens.with_words(lines, mode=mode, lower=lower))

    return run


QUERIES["tokenize_space"] = _mode_counts("space", False)
QUERIES["tokenize_whitespace"] = _mode_counts("whitespace", False)
QUERIES["tokenize_tfidf"] = _mode_counts("tfidf", False)
QUERIES["tokenize_punct"] = _mode_counts("punct", True)


@query
def drop_stopwords(spark, folder):
    terms = tokens.explode_terms(tables.document_terms(spark, folder), "period")
    kept = tokens.drop_stopwords(terms, _common_terms(spark, folder))
    return kept.groupBy("period", "term").agg(F.count(F.lit(1)).alias("n"))


@query
def drop_stopwords_list(spark, folder):
    terms = tokens.explode_terms(tables.document_terms(spark, folder), "period")
    kept = tokens.drop_stopwords(terms, STOPWORDS)
    return kept.groupBy("period", "term").agg(F.count(F.lit(1)).alias("n"))


@query
def drop_long_stopwords(spark, folder):
    """All terms of one document only, thousands of them, dropped inside the rows."""
    # Read twice, for the list and for the rows.
    documents = materialize(tables.document_terms(spark, folder), "terms")
    rare = tokens.distinct_terms(documents, "id").groupBy("term").agg(F.count("id").alias("df"))
    kept = tokens.clean_words(
        documents, ("id",), stopwords=rare.where(F.col("df") == 1).select("term")
    )
    return kept.select("id", F.array_join("words", " ").alias("words"))


@query
def keep_words_in_row(spark, folder):
    """Stop words and the a-to-z rule applied inside the word arrays."""
    lines = tokens.with_words(tables.document_lines(spark, folder))
    kept = keep_words(F.col("words"), lowercase_initial=True, stopwords=STOPWORDS)
    return lines.select("id", F.array_join(kept, " ").alias("words"))


@query
def keep_lowercase(spark, folder):
    lines = tokens.with_words(tables.document_lines(spark, folder))
    kept = tokens.keep_lowercase(tokens.explode_terms(lines))
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def keep_alphabetic(spark, folder):
    lines = tokens.with_words(tables.document_lines(spark, folder), mode="whitespace")
    kept = tokens.keep_alphabetic(tokens.explode_terms(lines))
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# -- counts and weights -------------------------------------------------------


@query
def corpus_totals(spark, folder):
    return jobs.corpus_totals(tables.document_lines(spark, folder))


@query
def corpus_totals_dated(spark, folder):
    return jobs.corpus_totals(tables.dated_lines(spark, folder))


@query
def initial_letter_counts(spark, folder):
    return jobs.initial_letter_counts(tables.document_lines(spark, folder))


@query
def initial_letter_lines(spark, folder):
    letters = jobs.initial_letter_counts(tables.conversation_lines(spark, folder))
    return letters.select(kv_line(F.col("letter"), F.col("n")).alias("output"))


@query
def term_counts(spark, folder):
    return counts.term_counts(tables.document_terms(spark, folder))


@query
def term_period_counts(spark, folder):
    return counts.term_period_counts(tables.document_terms(spark, folder))


@query
def period_frequency(spark, folder):
    return counts.period_frequency(tables.document_terms(spark, folder))


@query
def period_frequency_merged(spark, folder):
    """Number of periods of each term over two corpora, from the bitmaps of either."""
    corpora = [tables.document_terms(spark, folder), _turns(spark, folder)]
    numbers, bitmaps = None, []
    for corpus in corpora:
        counted = counts.term_period_counts(corpus)
        numbers = materialize(counts.number_periods(counted.select("period"), numbers), "periods")
        bitmaps.append(counts.period_bitmaps(counted, numbers))
    return counts.bitmap_frequency(counts.merge_period_bitmaps(*bitmaps))


@query
def tfidf_ordered_files(spark, folder):
    """Weights in their order: written as many text files, read back in file name order."""
    path = f"{scratch_folder(spark)}/textmine-ordered-{uuid.uuid4().hex}"
    weighted = _weights(spark, folder, beta=5.0, sort=False)
    lines = weighted.select(
        "term", "period", F.concat_ws(",", "term", "period", "weight").alias("output")
    )
    text_lines.write_ordered_lines(lines, path, ["term", F.desc("period")])
    return text_lines.read_ordered_lines(spark, path)


@query
def pairs_ordered_files(spark, folder):
    """Similar documents in the order of their ids, by way of text files."""
    path = f"{scratch_folder(spark)}/textmine-ordered-{uuid.uuid4().hex}"
    pairs = jobs.jaccard_self_join(tables.document_terms(spark, folder), 0.9, sort=False)
    lines = pairs.select("id1", "id2", id_pair_line(F.col("id1"), F.col("id2"), F.round("sim", 6)).alias("output"))
    text_lines.write_ordered_lines(lines, path, ["id1", "id2"])
    return text_lines.read_ordered_lines(spark, path)


@query
def top_pairs_ordered_files(spark, folder):
    """Top pairs in their order: period, then most frequent first."""
    path = f"{scratch_folder(spark)}/textmine-ordered-{uuid.uuid4().hex}"
    top = jobs.top_pairs_by_period(_dated(spark, folder), 20, sort=False)
    lines = top.select("*", period_pair_line(*(F.col(c) for c in top.columns)).alias("output"))
    order = ["period", F.desc("n"), "term1", "term2"]
    text_lines.write_ordered_lines(lines, path, order)
    return text_lines.read_ordered_lines(spark, path)


@query
def dense_token_ranks(spark, folder):
    """Ranks without gaps of the tokens that records share, rarest first."""
    records = setjoin.token_sets(tables.document_terms(spark, folder))
    return setjoin.token_ranks(records)


@query
def tfidf_by_period(spark, folder):
    return _weights(spark, folder)


@query
def tfidf_threshold(spark, folder):
    return _weights(spark, folder, beta=5.0)


@query
def tfidf_given_periods(spark, folder):
    return _weights(spark, folder, n_periods=100, beta=50.0)


@query
def tfidf_text(spark, folder):
    return jobs.tfidf_lines(_weights(spark, folder, beta=5.0))


@query
def tfidf_top_k(spark, folder):
    order = [F.desc("weight"), F.col("term")]
    return top_k_per_group(_weights(spark, folder, sort=False), ["period"], order, 10)


# -- pairs --------------------------------------------------------------------


@query
def unordered_pairs(spark, folder):
    pairs = cooccurrence.unordered_pairs(_dated(spark, folder), ("id", "period"))
    return pairs.select("id", "period", "term1", "term2", "n")


@query
def pair_counts_by_year(spark, folder):
    return cooccurrence.pair_counts(_dated(spark, folder))


@query
def top_pairs_by_year(spark, folder):
    return jobs.top_pairs_by_period(_dated(spark, folder), 3)


@query
def top_pairs_stopwords(spark, folder):
    return jobs.top_pairs_by_period(_dated(spark, folder), 10, stopwords=["small", "rod"])


@query
def top_pairs_text(spark, folder):
    top = jobs.top_pairs_by_period(_dated(spark, folder), 20)
    return top.select(period_pair_line(*(F.col(c) for c in top.columns)).alias("output"))


@query
def top_pairs_by_source(spark, folder):
    """Pairs within the lines of the documents."""
    lines = tokens.with_words(tables.document_lines(spark, folder), lower=True)
    stopwords = _common_terms(spark, folder)
    return jobs.top_pairs_by_period(lines, 10, stopwords=stopwords, prune=True)


@query
def top_pairs_by_source_unpruned(spark, folder):
    """The same from the counts of all pairs, long lines spread over the tasks."""
    lines = tokens.with_words(tables.document_lines(spark, folder), lower=True)
    spread = 4 * spark.sparkContext.defaultParallelism
    stopwords = _common_terms(spark, folder)
    return jobs.top_pairs_by_period(lines, 10, stopwords=stopwords, spread=spread)


@query
def top_pairs_by_source_documents(spark, folder):
    """Whole documents as the unit instead of lines."""
    documents = tables.document_terms(spark, folder)
    stopwords = _common_terms(spark, folder)
    return jobs.top_pairs_by_period(documents, 10, stopwords=stopwords, prune=True)


@query
def directional_cooccurrence(spark, folder):
    return jobs.directional_cooccurrence(tables.dated_lines(spark, folder))


@query
def directional_cooccurrence_turns(spark, folder):
    return jobs.directional_cooccurrence(tables.conversation_lines(spark, folder))


@query
def cooccurrence_lines(spark, folder):
    pairs = jobs.directional_cooccurrence(tables.dated_lines(spark, folder))
    key = F.concat_ws(" ", "term", "other")
    return pairs.select(kv_line(key, F.col("n")).alias("output"))


@query
def stripes_text(spark, folder):
    lines = tables.dated_lines(spark, folder)
    stripes = cooccurrence.as_stripes(jobs.directional_cooccurrence(lines, sort=False))
    entries = F.transform(F.map_entries("stripe"), lambda e: kv_line(e["key"], e["value"], ":"))
    return stripes.select("term", "part", F.array_join(entries, ",").alias("stripe"))


@query
def stripes_merged(spark, folder):
    """Directional stripes of every year, in parts of few entries, summed entry by entry."""
    lines = tables.dated_lines(spark, folder).withColumn("year", F.substring("value", 1, 4))
    counted = jobs.directional_cooccurrence(lines, keys=["year"], sort=False)
    stripes = cooccurrence.as_stripes(counted, keys=["year"], max_entries=20)
    return cooccurrence.merge_stripes(stripes)


@query
def stripes_in_batches(spark, folder):
    """Stored stripes after three batches; the last two years come with a year too many."""
    lines = tables.dated_lines(spark, folder).withColumn("year", F.substring("value", 1, 4))
    counted = materialize(
        jobs.directional_cooccurrence(lines, keys=["year"], sort=False), "counts-by-year"
    )
    early, late = F.col("year") < "1995", F.col("year") >= "1997"
    first = counted.where(early)
    taken_back = first.withColumn("n", -F.col("n"))
    batches = [first, counted.where(~early & ~late).union(first), counted.where(late).union(taken_back)]
    stored = None
    for batch in batches:
        merged = cooccurrence.apply_deltas(stored, batch, max_entries=20)
        stored = materialize(merged, "stripes")
    return cooccurrence.stripes_to_rows(stored)


@query
def repeated_lines(spark, folder):
    """Bags of dated lines, equal ones of a year as one row."""
    bags = cooccurrence.with_bags(_dated(spark, folder), ["period"])
    distinct = cooccurrence.distinct_bags(bags, ["period"])
    terms = F.transform("bag", lambda e: F.concat_ws(":", e["term"], e["n"]))
    return distinct.select("period", F.array_join(terms, " ").alias("bag"), "lines")


@query
def top_pairs_many(spark, folder):
    """The 300 most frequent pairs of each source in whole documents, by bucket sums."""
    documents = tables.document_terms(spark, folder)
    return jobs.top_pairs_by_period(documents, 300, stopwords=_common_terms(spark, folder))


# -- similarity join ----------------------------------------------------------


@query
def token_order(spark, folder):
    return ranking.token_order(tables.document_terms(spark, folder))


@query
def rarity_sorted(spark, folder):
    ranked = ranking.rarity_sorted(tables.document_terms(spark, folder))
    return ranked.withColumn("tokens", F.array_join("tokens", " "))


@query
def prefix_tokens(spark, folder):
    return ranking.prefix_tokens(tables.document_terms(spark, folder), 0.8)


@query
def shared_tokens(spark, folder):
    return ranking.shared_tokens(tables.document_terms(spark, folder), 0.8)


@query
def distinct_sets(spark, folder):
    records = setjoin.token_sets(tables.document_terms(spark, folder))
    sets = setjoin.distinct_sets(records)
    return sets.select("set_id", "n", "copies", "first_period", "last_period")


def _candidates(spark: SparkSession, folder: str, tau: float) -> DataFrame:
    records = materialize(setjoin.token_sets(tables.document_terms(spark, folder)), "records")
    sets = materialize(setjoin.distinct_sets(records), "sets")
    ranks = materialize(setjoin.token_ranks(records), "ranks")
    encoded = materialize(setjoin.encode_sets(records, sets, ranks), "encoded")
    discard(records)
    return setjoin.candidate_sets(encoded, ranks, tau)


@query
def candidate_sets(spark, folder):
    return _candidates(spark, folder, 0.8)


@query
def candidate_sets_half(spark, folder):
    return _candidates(spark, folder, 0.5)


@query
def similar_sets(spark, folder):
    return setjoin.similar_sets(tables.document_terms(spark, folder), 0.8).pairs


@query
def jaccard_self_join(spark, folder):
    return jobs.jaccard_self_join(tables.document_terms(spark, folder), 0.8)


@query
def jaccard_self_join_half(spark, folder):
    return jobs.jaccard_self_join(tables.document_terms(spark, folder), 0.5)


@query
def jaccard_self_join_any(spark, folder):
    documents = tables.document_terms(spark, folder)
    return jobs.jaccard_self_join(documents, 0.8, cross_period=False)


@query
def jaccard_equal_sets(spark, folder):
    return jobs.jaccard_self_join(tables.document_terms(spark, folder), 1.0)


@query
def jaccard_turns(spark, folder):
    return jobs.jaccard_self_join(_turns(spark, folder), 0.1)


@query
def jaccard_text(spark, folder):
    pairs = jobs.jaccard_self_join(tables.document_terms(spark, folder), 0.9)
    rounded = F.round("sim", 6)
    return pairs.select(id_pair_line(F.col("id1"), F.col("id2"), rounded).alias("output"))
