"""Column functions over text: tokenizers, word filters, term bags, output lines.

Everything here is a composition of built-in Spark SQL functions, so the work
stays in the JVM and inside the plan of the caller's DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that decide where one word ends and the next begins.
FIELD_SEPARATOR = ","
BLANK = " "
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
FIELD_OR_BLANK = r"(?U)\t|,|; |[\s\x1c-\x1f]"
PUNCTUATION = r"""[ *$&#/\t\n\f"',.:;?!\[\](){}<>~\-_]"""
NON_LETTERS = r"[^\p{L}]+"

# Shapes of the output lines.
PERIOD_PAIR_FORMAT = "%s    %s,%s:%d"
ID_PAIR_FORMAT = "(%d,%d)    %s"

TOKENIZERS: dict[str, str] = {
    "space": BLANK,
    "whitespace": WHITESPACE,
    "tfidf": FIELD_OR_BLANK,
    "punct": PUNCTUATION,
    "letters": NON_LETTERS,
}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain Python variable would repeat the expression wherever it is used,
    and inside a lambda that means once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop white space, Unicode white space included, at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def tokenize(text: Column, mode: str = "space") -> Column:
    """Split ``text`` into ``array<string>`` without empty strings."""
    if mode not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {mode!r}, choose from {sorted(TOKENIZERS)}")
    return F.array_remove(F.split(text, TOKENIZERS[mode]), "")


def starts_lowercase(word: Column) -> Column:
    """True where the first character is one of a to z."""
    return F.substring(word, 1, 1).between("a", "z")


def starts_alphabetic(word: Column) -> Column:
    """True where the first character is a letter of any script."""
    return word.rlike(r"^\p{L}")


def keep_words(
    words: Column,
    *,
    lowercase_initial: bool = False,
    stopwords: Iterable[str] = (),
) -> Column:
    """Filter a word array in place of the row; repeated words stay repeated.

    Nulls among the stop words are ignored.
    """
    listed = [w for w in stopwords if w is not None]
    kept = words
    if listed:
        kept = F.filter(kept, lambda w: ~w.isin(listed))
    if lowercase_initial:
        kept = F.filter(kept, starts_lowercase)
    return kept


def term_bag(words: Column) -> Column:
    """``array<struct<term, n>>``: each distinct word with its multiplicity.

    Sorted by term. Equal words are neighbours once the array is sorted, so the
    bag is read off the start positions of the runs: n log n per row and no
    shuffle, where an explode and a count per (row, word) would need one.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return bind(
            starts,
            lambda first: F.transform(
                first,
                lambda start, j: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(first, j + 1), F.size(ordered)) - start)
                    .cast("bigint")
                    .alias("n"),
                ),
            ),
        )

    known = F.array_compact(words)
    return F.when(F.size(known) > 0, bind(F.sort_array(known), runs))


def json_scalar(value: Column) -> Column:
    """A single value as JSON text."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def kv_line(key: Column, value: Column, sep: str = " ") -> Column:
    """``key`` and ``value`` on one line."""
    return F.concat_ws(sep, key.cast("string"), value.cast("string"))


def json_kv_line(key: Column, value: Column) -> Column:
    """``key`` TAB ``value``, both as JSON."""
    return F.concat_ws("\t", json_scalar(key), json_scalar(value))


def period_pair_line(period: Column, term1: Column, term2: Column, n: Column) -> Column:
    """``2003    council,welcomes:2``"""
    return F.format_string(PERIOD_PAIR_FORMAT, period, term1, term2, n)


def id_pair_line(id1: Column, id2: Column, sim: Column) -> Column:
    """``(0,7)    0.125``"""
    return F.format_string(ID_PAIR_FORMAT, id1, id2, sim.cast("string"))
