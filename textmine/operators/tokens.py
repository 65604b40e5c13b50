"""From rows with a word array to rows with one term, and filters on either."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.functions.text import keep_words, starts_alphabetic, starts_lowercase, tokenize
from textmine.sources.scratch import materialize

# A stop-word list up to this length is put into the plan as literals. A longer
# one is joined. The result does not depend on it.
MAX_INLINE_STOPWORDS = 5_000


def with_words(
    df: DataFrame, *, text: str = "value", mode: str = "space", lower: bool = False
) -> DataFrame:
    """Add ``words``, the tokens of a text column."""
    source = F.lower(F.col(text)) if lower else F.col(text)
    return df.withColumn("words", tokenize(source, mode))


def explode_terms(df: DataFrame, *keys: str, words: str = "words") -> DataFrame:
    """``<keys..., term>``: one row per word; empty and null arrays give none.

    The outer generator with a filter after it does what the inner one does, but
    keeps Spark from deriving a filter on the size of the array, which would
    tokenize the text a second time below the projection.
    """
    return df.select(*keys, F.explode_outer(words).alias("term")).where(F.col("term") != "")


def distinct_terms(df: DataFrame, *keys: str, words: str = "words") -> DataFrame:
    """As :func:`explode_terms`, each term once per input row."""
    return df.select(*keys, F.explode_outer(F.array_distinct(words)).alias("term")).where(
        F.col("term") != ""
    )


def keep_lowercase(terms: DataFrame, *, term: str = "term") -> DataFrame:
    """Rows whose term starts with a to z."""
    return terms.where(starts_lowercase(F.col(term)))


def keep_alphabetic(terms: DataFrame, *, term: str = "term") -> DataFrame:
    """Rows whose term starts with a letter of any script."""
    return terms.where(starts_alphabetic(F.col(term)))


def drop_stopwords(
    terms: DataFrame, stopwords: DataFrame | Iterable[str], *, term: str = "term"
) -> DataFrame:
    """Anti join against the stop words; nulls among them are ignored.

    A list of moderate length is a set lookup in the plan; a longer one or a frame
    is joined, broadcast by Spark only if its size is below the session's threshold.
    """
    if not isinstance(stopwords, DataFrame):
        listed = [w for w in stopwords if w is not None]
        if len(listed) <= MAX_INLINE_STOPWORDS:
            return terms.where(~F.col(term).isin(listed)) if listed else terms
        stopwords = terms.sparkSession.createDataFrame([(w,) for w in listed], "term string")
    unwanted = stopwords.select(F.col(stopwords.columns[0]).alias(term)).distinct()
    return terms.join(unwanted, term, "left_anti").select(*terms.columns)


def clean_words(
    df: DataFrame,
    keys: Sequence[str],
    *,
    stopwords: DataFrame | Iterable[str] | None = None,
    lowercase_initial: bool = False,
    words: str = "words",
) -> DataFrame:
    """``<keys..., words>`` without stop words, row by row.

    Every row stays, also with no word left (an empty array); words keep their
    order and multiplicity, however many stop words there are. The length of the
    list only chooses the plan: a short one filters the arrays in place, a long
    one is joined to the words, and those found are cut out by their places.
    """
    listed: list[str] | None = []
    if isinstance(stopwords, DataFrame):
        # Written once: read for its length here and for its rows by the join,
        # where the size of the table decides whether it is broadcast.
        term = F.col(stopwords.columns[0]).alias("term")
        stopwords = materialize(
            stopwords.select(term).where(F.col("term").isNotNull()).distinct(), "stopwords"
        )
        rows = stopwords.take(MAX_INLINE_STOPWORDS + 1)
        listed = [r[0] for r in rows] if len(rows) <= MAX_INLINE_STOPWORDS else None
    elif stopwords is not None:
        given = [w for w in stopwords if w is not None]
        listed = given if len(given) <= MAX_INLINE_STOPWORDS else None
        stopwords = given
    if listed is not None:
        kept = keep_words(F.col(words), lowercase_initial=lowercase_initial, stopwords=listed)
        return df.select(*keys, kept.alias("words"))

    # The row numbers are written, as a retried task might deal them out anew.
    numbered = materialize(
        df.select(
            *keys,
            F.monotonically_increasing_id().alias("_row"),
            F.array_compact(keep_words(F.col(words), lowercase_initial=lowercase_initial)).alias(
                "words"
            ),
        ),
        "words",
    )
    # Only the places of stop words move and are joined back; the words between them
    # are cut from the row, which costs its length and the number of places.
    if not isinstance(stopwords, DataFrame):
        stopwords = df.sparkSession.createDataFrame([(w,) for w in stopwords], "term string")
    places = (
        numbered.select("_row", F.posexplode_outer("words").alias("_at", "term"))
        .where(F.col("term").isNotNull())
        .join(stopwords.distinct(), "term", "left_semi")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list("_at")).alias("_places"))
    )
    bounds = F.concat(F.array(F.lit(-1)), F.col("_places"), F.array(F.size("words")))
    between = F.transform(
        F.arrays_zip(
            F.slice(bounds, F.lit(1), F.size("_places") + 1).alias("after"),
            F.slice(bounds, F.lit(2), F.size("_places") + 1).alias("before"),
        ),
        lambda gap: F.slice(F.col("words"), gap["after"] + 2, gap["before"] - gap["after"] - 1),
    )
    return numbered.join(places, "_row", "left").select(
        *keys,
        F.when(F.col("_places").isNull(), F.col("words")).otherwise(F.flatten(between)).alias("words"),
    )
