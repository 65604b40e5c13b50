"""Pairs of terms that share a line."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from textmine.functions.text import term_bag
from textmine.operators import pair_blocks
from textmine.sources.package import ship_package
from textmine.sources.scratch import materialize

# Left-hand terms per piece of a line.
TERMS_PER_PIECE = 64
# Pairs of a term and a word that a part of the directional counts is expected to hold, and the
# least for which there is another part while there are fewer than the session's.
PAIRS_PER_PART, LEAST_PER_PART = 4_000_000, 100_000
# Pairs of a line from which on it is many rows.
PAIRS_PER_LINE = 1 << 26
# Pairs that are counted to find how to deal them, and entries of them that are looked at.
PAIRS_TRIED, CUT_CANDIDATES = 1 << 26, 200_000
# Entries a single stripe row may be expected to hold.
ENTRIES_PER_STRIPE = 10_000


def with_bags(df: DataFrame, keys: Sequence[str], words: str = "words") -> DataFrame:
    """``<keys..., bag>``: the words of each row as sorted terms with multiplicities."""
    return df.select(*keys, term_bag(F.col(words)).alias("bag"))


def distinct_bags(bags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``<keys..., bag, lines>``: equal bags of a group are one row, with their number.

    Copies are combined before the shuffle, so a line that a third of the rows
    repeat neither travels nor is expanded more than once per task.
    """
    return bags.groupBy(*keys, "bag").agg(_lines(bags).alias("lines"))


def _lines(bags: DataFrame) -> Column:
    return F.sum("lines") if "lines" in bags.columns else F.count(F.lit(1))


def line_pieces(bags: DataFrame, keys: Sequence[str], *, combine: bool = True) -> DataFrame:
    """``<keys..., piece, lines>``: pieces of bags, equal ones as one row with their number.

    A piece is what follows a bag's left-hand terms, and they themselves; its pairs
    are those of its first ``TERMS_PER_PIECE`` entries with all that follow. The work
    of a line grows with its square while its bytes do not, so pieces, not lines, are
    what the shuffle deals out. Without ``combine`` every piece stays a row of its own.
    """
    last = F.greatest(F.size("bag") - 1, F.lit(0))
    carried = ["lines"] if "lines" in bags.columns else []
    starts = bags.select(
        *keys,
        *carried,
        "bag",
        F.explode_outer(F.sequence(F.lit(0), last, F.lit(TERMS_PER_PIECE))).alias("at"),
    )
    pieces = starts.select(
        *keys,
        *(carried if carried or combine else [F.lit(1).cast("long").alias("lines")]),
        F.slice("bag", F.col("at") + 1, F.size("bag")).alias("piece"),
    )
    return pieces.groupBy(*keys, "piece").agg(_lines(pieces).alias("lines")) if combine else pieces


def _piece_pairs(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``<keys..., lines, a, b>``: entries of a piece with a before b or a = b.

    Two generators in a row stream the pairs; no array of all pairs is built.
    """
    left = pieces.select(
        *keys,
        "lines",
        "piece",
        F.posexplode_outer(F.slice("piece", 1, TERMS_PER_PIECE)).alias("i", "a"),
    )
    rest = F.slice(F.col("piece"), F.col("i") + 1, F.size("piece"))
    return left.select(*keys, "lines", "a", F.explode_outer(rest).alias("b"))


def bag_pairs(
    bags: DataFrame,
    keys: Sequence[str],
    *,
    spread: int | None = None,
    combine: bool = True,
) -> DataFrame:
    """``<keys..., term1, term2, n>`` of pieces of bags, term1 <= term2.

    ``n`` is the number of position pairs that hold the two terms: the product of
    the multiplicities, or m (m - 1) / 2 for a term with itself, times the number of
    lines with the piece. ``spread`` deals the pieces out anew over so many
    partitions, whatever size Spark thinks they need.
    """
    pieces = line_pieces(bags, keys, combine=combine)
    if spread is not None:
        pieces = pieces.repartition(spread)
    a, b = F.col("a"), F.col("b")
    n = F.when(
        a["term"] == b["term"], (a["n"] * (a["n"] - 1) / 2).cast("bigint")
    ).otherwise(a["n"] * b["n"])
    return (
        _piece_pairs(pieces, keys)
        .select(
            *keys,
            a["term"].alias("term1"),
            b["term"].alias("term2"),
            (n * F.col("lines")).alias("n"),
        )
        .where(F.col("n") > 0)
    )


def unordered_pairs(
    df: DataFrame, keys: Sequence[str] = ("period",), *, words: str = "words"
) -> DataFrame:
    """``<keys..., term1, term2, n>``: the pairs of every row, row by row."""
    return bag_pairs(with_bags(df, keys, words), keys, combine=False)


def count_pairs(
    bags: DataFrame, keys: Sequence[str], *, spread: int | None = None
) -> DataFrame:
    """``<keys..., term1, term2, n>`` over all bags; with ``lines``, each so many times."""
    pairs = bag_pairs(bags, keys, spread=spread)
    return pairs.groupBy(*keys, "term1", "term2").agg(F.sum("n").alias("n"))


def pair_counts(
    df: DataFrame,
    keys: Sequence[str] = ("period",),
    *,
    words: str = "words",
    spread: int | None = None,
) -> DataFrame:
    """``<keys..., term1, term2, n>`` over all lines."""
    return count_pairs(with_bags(df, keys, words), keys, spread=spread)


def directional_counts(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    words: str = "words",
    spread: int | None = None,
    sort: bool = False,
) -> DataFrame:
    """``<keys..., term, other, n>``: how often ``other`` stands in lines that have ``term``.

    A line with the term counts once for it, however often the term is repeated;
    ``other`` counts with its multiplicity. The lines are written once, when this is called.
    Tasks sum up the pairs of many lines before anything moves, and what moves are packed
    blocks of sums (:mod:`textmine.operators.pair_blocks`). Blocks are dealt by ranges of
    term and other, whatever their keys, so a frequent term is many parts and parts in
    their order are the sorted result. ``sort`` orders by ``keys``, term, other.

    There are ``spread`` parts. Without it, there are as many as the sums of some lines
    show to be needed, so that parts grow in number and not in size.
    """
    spark = df.sparkSession
    ship_package(spark)
    keys = list(keys)
    lines = materialize(df.select(*keys, F.col(words).alias("words")), "lines")
    known = lines.agg(F.sum(_pairs_of("words")).alias("pairs"), F.max(_pairs_of("words")).alias("most")).head()
    lines = _cut_lines(lines, known["most"] or 0)
    cuts = _cuts(lines, keys, known["pairs"] or 0, spread)
    own = [lines.schema[k] for k in keys]
    block = StructType([*own, StructField("part", IntegerType()), StructField("block", BinaryType())])
    entries = ArrayType(StructType([StructField("other", StringType()), StructField("n", LongType())]))
    stripe = StructType([*own, StructField("term", StringType()), StructField("entries", entries)])
    blocks = lines.mapInArrow(pair_blocks.dealt(keys, cuts, to_arrow_schema(block)), block)
    summed = (
        blocks.repartitionById(len(cuts) + 1, F.col("part"))
        .select(*keys, "block")
        .mapInArrow(pair_blocks.summed(keys, to_arrow_schema(stripe)), stripe)
    )
    counted = summed.select(*keys, "term", F.inline("entries"))
    if not sort:
        return counted
    return counted.orderBy(*keys, "term", "other") if keys else counted.sortWithinPartitions("term", "other")


def _cut_lines(lines: DataFrame, most: int) -> DataFrame:
    """Add ``at`` and ``upto``, between which the left-hand terms of a row are among its line's.

    A line of more pairs than a part should have is many rows, dealt out over the tasks.
    """
    everything = [F.lit(0).alias("at"), F.lit(pair_blocks.ALL).alias("upto")]
    if most <= PAIRS_PER_LINE:
        return lines.select("*", *everything)
    long = F.coalesce(_pairs_of("words") > PAIRS_PER_LINE, F.lit(False))
    step = F.greatest(F.floor(F.lit(PAIRS_PER_LINE) / F.size("words")), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.size(F.array_distinct("words")) - 1, step)
    pieces = lines.where(long).select("*", F.explode(starts).alias("at"), step.alias("step"))
    cores = lines.sparkSession.sparkContext.defaultParallelism
    dealt = pieces.repartition(4 * cores).select(*lines.columns, "at", (F.col("at") + F.col("step")).alias("upto"))
    return lines.where(~long).select("*", *everything).unionAll(dealt)


def _cuts(lines: DataFrame, keys: list[str], pairs: int, spread: int | None) -> list[tuple[str, str]]:
    """The least pairs of all parts but the first.

    They come from the sums of some lines and decide on sizes of parts only; every line is
    counted after that.
    """
    if not pairs or spread == 1:
        return []
    share = min(1.0, PAIRS_TRIED / pairs)
    some = lines.sample(share, 7) if share < 1 else lines
    rate = min(1.0, CUT_CANDIDATES / min(pairs, PAIRS_TRIED))
    schema = "term string, other string, weight double"
    tried = some.mapInArrow(pair_blocks.candidates(keys, rate), schema).toArrow()
    tried = tried.sort_by([("term", "ascending"), ("other", "ascending")])
    summed = np.cumsum(tried.column("weight").to_numpy())
    if not len(summed):
        return []
    entries = summed[-1] / share
    session = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = spread or max(math.ceil(entries / PAIRS_PER_PART), min(session, math.ceil(entries / LEAST_PER_PART)))
    at = np.unique(np.searchsorted(summed, summed[-1] / parts * np.arange(1, parts)))
    at = at[at < len(summed)]
    found = tried.select(["term", "other"]).take(pa.array(at)).to_pylist()
    return sorted({(r["term"], r["other"]) for r in found})


def _pairs_of(words: str) -> Column:
    """How many pairs of a term and a word a line has."""
    return F.size(F.array_distinct(words)).cast("long") * F.size(words)


def _frequent(df: DataFrame, words: str) -> list[str]:
    """Terms with more pairs than a part should have, which are parts by ranges of the other word."""
    terms = df.select(
        F.size(words).cast("long").alias("pairs"), F.explode(F.array_distinct(words)).alias("term")
    )
    sums = terms.groupBy("term").agg(F.sum("pairs").alias("pairs"))
    return [r["term"] for r in sums.where(F.col("pairs") > PAIRS_PER_PART).collect()]


def as_stripes(
    counts: DataFrame, *, keys: Sequence[str] = (), max_entries: int = ENTRIES_PER_STRIPE
) -> DataFrame:
    """``<keys..., term, part, stripe: map<string, bigint>>`` from ``<keys..., term, other, n>``.

    A term with up to ``max_entries`` partners has the one part 0. A term that
    goes with most of the vocabulary is cut into parts by a hash of the partner,
    so that no row and no task has to hold an unbounded map. The counts are read twice, so
    they are written when this is called.
    """
    counts = materialize(counts, "counts")
    sizes = counts.groupBy(*keys, "term").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(max_entries)).alias("parts")
    )
    return _stripes(counts.join(sizes, [*keys, "term"]), keys)


def _stripes(entries: DataFrame, keys: Sequence[str], *carried: str) -> DataFrame:
    """Stripes of ``<keys..., term, parts, other, n>``."""
    listed = F.sort_array(F.collect_list(F.struct("other", "n")))
    return (
        entries.withColumn("part", _part_of("other", "parts"))
        .groupBy(*keys, "term", *carried, "part")
        .agg(F.map_from_entries(listed).alias("stripe"))
    )


def _part_of(other: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(other), F.col(parts))


def apply_deltas(
    stored: DataFrame | None, deltas: DataFrame, *, max_entries: int = ENTRIES_PER_STRIPE
) -> DataFrame:
    """Stored stripes after a batch of signed counts: ``<term, parts, part, stripe>``.

    ``deltas`` is ``<term, other, n>`` with negative ``n`` for what is taken back; rows
    may repeat a pair. Only parts that the batch touches are merged with it, entry by
    entry; all others pass through as they are. Entries that sum to zero leave, and so
    do parts without entries. A term keeps its number of parts until it would hold more
    than twice ``max_entries`` in each; then the number doubles, which splits every part
    in two by the same hash.

    Write the result before the next batch; ``stored`` is None for the first one.
    """
    summed = deltas.groupBy("term", "other").agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    arriving = summed.groupBy("term").agg(F.count(F.lit(1)).alias("new"))
    if stored is None:
        sizes = arriving.select("term", F.ceil(F.col("new") / max_entries).alias("parts"))
        return _stripes(summed.join(sizes, "term"), (), "parts")

    held = stored.groupBy("term", "parts").agg(F.sum(F.size("stripe")).alias("held"))
    growth = arriving.join(held, "term", "left").select(
        "term",
        F.coalesce("parts", F.lit(0)).alias("before"),
        (F.coalesce("held", F.lit(0)) + F.col("new")).alias("entries"),
    )
    full = F.col("entries") / (2 * max_entries * F.col("before"))
    doubled = F.col("before") * F.pow(F.lit(2), F.greatest(F.ceil(F.log2(full)), F.lit(0)))
    planned = growth.select(
        F.col("term").alias("_term"),
        "before",
        F.when(F.col("before") == 0, F.ceil(F.col("entries") / max_entries))
        .otherwise(doubled)
        .cast("bigint")
        .alias("after"),
    )
    # Parts of terms that get more of them are split; the others keep their rows.
    named = stored.join(planned, F.col("term") == F.col("_term"), "left")
    growing = F.coalesce(F.col("after") > F.col("parts"), F.lit(False))
    staying = named.where(~growing).select("term", "parts", "part", "stripe")
    split = _stripes(
        named.where(growing).select(
            "term", F.col("after").alias("parts"), F.explode("stripe").alias("other", "n")
        ),
        (),
        "parts",
    )
    new = _stripes(
        summed.join(planned, F.col("term") == F.col("_term")).select(
            "term", F.col("after").alias("parts"), "other", "n"
        ),
        (),
        "parts",
    ).withColumnRenamed("stripe", "delta")
    total = F.map_zip_with(
        F.coalesce("stripe", F.map_from_arrays(F.array(), F.array()).cast("map<string, bigint>")),
        "delta",
        lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)),
    )
    merged = F.when(F.col("delta").isNull(), F.col("stripe")).otherwise(
        F.map_filter(total, lambda _, n: n != 0)
    )
    return (
        staying.unionByName(split)
        .join(new, ["term", "parts", "part"], "full")
        .select("term", "parts", "part", merged.alias("stripe"))
        .where(F.size("stripe") > 0)
    )


def stripes_to_rows(stripes: DataFrame) -> DataFrame:
    """``<term, other, n>`` back from stripes, parts or whole ones."""
    return stripes.select("term", F.explode("stripe").alias("other", "n"))


def merge_stripes(stripes: DataFrame) -> DataFrame:
    """Entry-wise sum of stripes that may repeat a term, as ``<term, other, n>``."""
    return stripes_to_rows(stripes).groupBy("term", "other").agg(F.sum("n").alias("n"))
