"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.sources.scratch import materialize


def _stars(edges: DataFrame, *, large: bool) -> DataFrame:
    """One star round over ``<v, u>`` with u < v.

    Large: every vertex ties its larger neighbours to its smallest one. Small:
    it ties itself and its smaller neighbours to the smallest one. Either keeps
    the components and shortens the paths in them.
    """
    if large:
        near = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = near.groupBy("v").agg(F.min("u").alias("m"))
        least = least.select("v", F.least("m", "v").alias("m"))
        tied = near.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    else:
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        tied = (
            edges.join(least, "v")
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(least.select("v", F.col("m").alias("u")))
        )
    return tied.where("u < v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``<v, component>`` of every linked vertex: the smallest id it can reach.

    ``links`` may hold a pair in any order and several times. Rounds are written
    to the shared folder; their number grows with the logarithm of the longest
    path. No vertex's neighbours are gathered in one place.
    """
    edges = materialize(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .distinct(),
        "links",
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    before = state(edges)
    while before[0]:
        edges = materialize(_stars(_stars(edges, large=True), large=False), "links")
        now = state(edges)
        if now == before:
            break
        before = now
    found = edges.select("v", F.col("u").alias("component"))
    roots = edges.select(F.col("u").alias("v"), F.col("u").alias("component")).distinct()
    return found.union(roots)
