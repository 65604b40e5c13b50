"""Exact pruning of terms and pairs before the most frequent pairs are counted.

Pairs are quadratic in the length of a line and almost all of them are rare. Two kinds
of bounds keep them out of the counting shuffle, both for every group on its own:

* A term with multiplicity m in a line gives at most m * (highest multiplicity of the
  line) to any one pair, so the sum of that over its lines bounds every pair the term is
  in. This is linear in the text and removes most terms.
* The pairs of the terms that are left fall into a fixed number of hash buckets. A
  bucket's sum bounds each of its pairs from above. Sums are combined inside the tasks,
  so what is shuffled is the table of buckets, not the pairs.

Both need a floor: a count that k pairs of the group are known to reach. Counting the
pairs among a few strong terms gives k real counts. The buckets give a second floor: the
largest contribution of a single line to a bucket is a count that a pair of it reaches,
and pairs of different buckets are different. It holds also for groups in which the
strong terms form fewer than k pairs. The higher floor counts, and the step repeats:
raised floors remove terms, and then the pairs of light buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmine.operators.cooccurrence import bag_pairs, count_pairs, distinct_bags
from textmine.operators.topk import top_k_per_group
from textmine.sources.scratch import discard, materialize

# Strong terms per group, at least; their pairs number about half the square.
SEED_TERMS = 64
# Buckets per group.
BUCKETS = 1 << 16
# Pairs in the lines up to which bucket sums are not worth a pass of their own.
FEW_PAIRS = 2_000_000
# Different pairs that the terms of all groups can form, up to which the sums inside the
# tasks leave so little to shuffle that nothing is pruned.
FEW_DISTINCT = 4_000_000
# Heavy buckets up to which they are looked up while pairs are made.
MOST_HEAVY = 200_000


def pair_order() -> list[Column]:
    """Most frequent first, equal counts by term."""
    return [F.desc("n"), F.col("term1"), F.col("term2")]


def _same(keys: Sequence[str]) -> Column:
    """Equal keys of ``e`` and ``t``; rows without a period are a group as well."""
    return reduce(
        and_, (F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys), F.lit(True)
    )


def _entries(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lines.select("line", *keys, "lines", "most", F.inline_outer("bag")).where(
        F.col("term").isNotNull()
    )


def _bags_of(entries: DataFrame, terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bags again, with the listed terms only; equal ones are one row."""
    e, t = entries.alias("e"), terms.alias("t")
    rebuilt = (
        e.join(t, _same(keys) & (F.col("e.term") == F.col("t.term")))
        .select("e.*")
        .groupBy("line", *keys, "lines")
        .agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("bag"))
    )
    return distinct_bags(rebuilt, keys)


def _numbered_lines(bags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct bags with a number that stays, as they are written."""
    return materialize(
        distinct_bags(bags, keys).select(
            F.monotonically_increasing_id().alias("line"),
            *keys,
            "lines",
            "bag",
            F.array_max("bag.n").alias("most"),
        ),
        "lines",
    )


def _seed_floors(
    entries: DataFrame, bounds: DataFrame, keys: Sequence[str], k: int
) -> DataFrame:
    """``<keys..., floor>`` of groups whose strong terms form ``k`` pairs."""
    n_seeds = max(SEED_TERMS, math.isqrt(2 * k) + 1)
    strongest = [F.desc("bound"), F.col("term")]
    seeds = materialize(
        top_k_per_group(bounds, keys, strongest, n_seeds).select(*keys, "term"), "seeds"
    )
    known = top_k_per_group(
        count_pairs(_bags_of(entries, seeds, keys), keys), keys, pair_order(), k
    )
    return (
        known.groupBy(*keys)
        .agg(F.min("n").alias("floor"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == k)
        .select(*keys, "floor")
    )


def _at_floor(rows: DataFrame, floors: DataFrame, keys: Sequence[str], bound: str) -> DataFrame:
    """The rows whose bound reaches their group's floor; groups without one keep all."""
    return (
        rows.alias("e")
        .join(floors.alias("t"), _same(keys), "left")
        .where(F.col(bound) >= F.coalesce("floor", F.lit(0)))
        .select("e.*")
    )


def bucket_of(terms: Sequence[str] = ("term1", "term2"), buckets: int | None = None) -> Column:
    return F.pmod(F.xxhash64(*terms), F.lit(buckets or BUCKETS)).alias("bucket")


def pair_buckets(
    pairs: DataFrame, keys: Sequence[str], *, buckets: int | None = None
) -> DataFrame:
    """``<keys..., bucket, total, single>``: sum and largest single count of each bucket."""
    return (
        pairs.select(*keys, bucket_of(buckets=buckets), "n")
        .groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("total"), F.max("n").alias("single"))
    )


def bucket_floors(sums: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``<keys..., floor>``: the k-th largest single count of a group's buckets.

    Each is reached by some pair of its bucket, so ``k`` different pairs reach the floor.
    """
    best = top_k_per_group(
        sums.select(*keys, "bucket", "single"), keys, [F.desc("single"), F.col("bucket")], k
    )
    return (
        best.groupBy(*keys)
        .agg(F.min("single").alias("floor"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == k)
        .select(*keys, "floor")
    )


def _higher(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first.unionByName(second).groupBy(*keys).agg(F.max("floor").alias("floor"))


def _bounded(bags: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Numbered lines, and ``<keys..., term, bound>`` of their terms."""
    lines = _numbered_lines(bags, keys)
    bound = F.sum(F.col("n") * F.col("most") * F.col("lines")).alias("bound")
    return lines, materialize(_entries(lines, keys).groupBy(*keys, "term").agg(bound), "bounds")


def _pruned(
    lines: DataFrame, bounds: DataFrame, keys: Sequence[str], k: int
) -> tuple[DataFrame, DataFrame]:
    entries = _entries(lines, keys)
    floors = materialize(_seed_floors(entries, bounds, keys, k), "floors")
    kept = materialize(_at_floor(bounds, floors, keys, "bound").select(*keys, "term"), "kept")
    return _bags_of(entries, kept, keys), floors


def promising_bags(bags: DataFrame, keys: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Bags reduced to terms that can be in the first ``k`` pairs, and the groups' floors.

    ``<keys..., bag, lines>`` and ``<keys..., floor>``. The intermediate tables are
    written, so their true size decides whether a join with the lines broadcasts them.
    """
    return _pruned(*_bounded(bags, keys), keys, k)


def promising_pairs(
    bags: DataFrame, keys: Sequence[str], k: int, *, spread: int | None = None
) -> DataFrame:
    """``<keys..., term1, term2, n>`` of lines, without pairs that cannot be in the first ``k``."""
    lines, bounds = _bounded(bags, keys)
    terms = bounds.groupBy(*keys).agg(F.count(F.lit(1)).alias("v"))
    distinct = terms.agg(F.sum(F.col("v") * (F.col("v") + 1) / 2)).head()[0] or 0
    if distinct <= FEW_DISTINCT:
        return bag_pairs(lines.select(*keys, "bag", "lines"), keys, spread=spread)

    reduced, floors = _pruned(lines, bounds, keys, k)
    reduced = materialize(reduced, "promising")
    size = F.size("bag").cast("long")
    many = reduced.agg(F.sum(size * (size + 1) / 2)).head()[0] or 0
    if many <= FEW_PAIRS:
        return bag_pairs(reduced, keys, spread=spread)

    sums = materialize(pair_buckets(bag_pairs(reduced, keys, spread=spread), keys), "buckets")
    raised = materialize(_higher(floors, bucket_floors(sums, keys, k), keys), "raised")
    heavy = materialize(
        _at_floor(sums, raised, keys, "total").select(*keys, "bucket"), "heavy-buckets"
    )
    # Terms once more, with the raised floors, as most of their entries cost pairs.
    lines, bounds = _bounded(reduced, keys)
    entries = _entries(lines, keys)
    kept = materialize(_at_floor(bounds, raised, keys, "bound").select(*keys, "term"), "kept-again")
    discard(sums)
    pairs = bag_pairs(_bags_of(entries, kept, keys), keys, spread=spread)
    if heavy.count() > MOST_HEAVY:
        return pairs
    named = pairs.select("*", bucket_of())
    return (
        named.alias("e")
        .join(heavy.alias("t"), _same(keys) & (F.col("e.bucket") == F.col("t.bucket")), "left_semi")
        .drop("bucket")
    )
