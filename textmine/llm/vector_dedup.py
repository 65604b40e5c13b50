"""Near-duplicate vectors by an index of pivot permutations.

Pivots are a bounded sample of the vectors. A vector is described by its nearest
pivots in order. The inverted lists are kept by combinations of three pivots, so
two vectors meet in C(s, 3) lists if they share s of their nearest pivots, and in
none if they share fewer than three: the count of shared pivots is the
retrieval condition. Vectors that meet are compared exactly, in double
precision, in blocks; a block pair returns counts of links and as many links as
connect its vectors, never all pairs. Equal vectors are one vector with a count.

Vectors of different dimensions never link. Each dimension has pivots and lists of its
own; a table has few dimensions, and usually one.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite
component links with nothing; repeated rows are linked; where nearest pivots are equally
near, that with the smaller number comes first; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmine.llm.common import list_arrays, whole_groups
from textmine.llm.components import connected_components
from textmine.sources.scratch import materialize

#: Nearest pivots that describe a vector, and how many of them two vectors must share.
NEAREST, SHARED = 8, 3
#: Pivots: this often the cube root of the number of vectors, within bounds.
PIVOT_FACTOR, LEAST_PIVOTS, MOST_PIVOTS = 8, 64, 2048
#: Vectors in a block.
BLOCK = 512


def _usable(vector: Column) -> Column:
    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    some = F.exists(vector, lambda x: x != 0)
    return ~F.exists(vector, odd) & some


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """The vectors of a list column as rows of length 1."""
    values, _ = list_arrays(column)
    rows = values.astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def near_vectors(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.95,
) -> DataFrame:
    """``<id, n_links, component_id, kept>`` of every row, linked at cosine >= threshold."""
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    rows = rows.withColumn("v", F.when(_usable(F.col("v")), F.col("v")))
    unique = materialize(
        rows.where("v is not null and id is not null")
        .groupBy("v")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")),
        "vectors",
    )
    sizes = [r["size"] for r in unique.select(F.size("v").alias("size")).distinct().collect()]
    known = spark.createDataFrame([], "w array<double>, n_links long, component_id long")
    for size in sorted(sizes):
        own = unique if len(sizes) == 1 else unique.where(F.size("v") == size)
        known = known.union(_linked(own, size, threshold))
    return rows.join(known, rows.v == known.w, "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNull(), 0)
        .otherwise(F.coalesce("n_links", F.lit(0)))
        .cast("long")
        .alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )


def _linked(unique: DataFrame, size: int, threshold: float) -> DataFrame:
    """``<w, n_links, component_id>`` of different vectors with ``size`` components."""
    spark = unique.sparkSession
    total = unique.count()
    wanted = min(max(LEAST_PIVOTS, round(PIVOT_FACTOR * total ** (1 / 3))), MOST_PIVOTS)
    # A bounded sample, chosen by a hash of the id.
    sample = unique.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("v").toArrow()
    pivots = spark.sparkContext.broadcast(_matrix(sample.column("v"), size))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pivots.value
        near = min(NEAREST, len(table))
        shared = min(SHARED, near)
        picks = np.array(list(combinations(range(near), shared)))
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                closeness = _matrix(part.column("v"), size) @ table.T
                order = np.argsort(-closeness, axis=1, kind="stable")[:, :near]
                chosen = np.sort(order[:, picks], axis=2)  # rows x combinations x shared
                key = np.zeros(chosen.shape[:2], np.int64)
                for j in range(shared):
                    key = key * (MOST_PIVOTS + 1) + chosen[:, :, j] + 1
                rep = part.column("rep").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel()), pa.array(np.repeat(rep, key.shape[1]))],
                    ["key", "rep"],
                )

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["key"]):
            keep = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
            yield from table.filter(pa.array(keep)).to_batches()

    shared = materialize(
        unique.select("v", "rep")
        .mapInArrow(describe, "key long, rep long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(met, "key long, rep long"),
        "pivot-lists",
    )
    # A vector's home is the smallest id it meets; homes are cut into blocks.
    hubs = shared.groupBy("key").agg(F.min("rep").alias("hub"))
    homes = materialize(
        shared.join(hubs, "key").groupBy("rep").agg(F.min("hub").alias("home")), "homes"
    )
    blocks = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocked = homes.join(blocks, "home").select(
        "rep", F.xxhash64("home", F.expr("pmod(xxhash64(rep), blocks)")).alias("block")
    )
    placed = materialize(shared.join(blocked, "rep"), "placed")
    others = placed.select("key", F.col("block").alias("other")).distinct()
    cells = (
        placed.join(others, "key")
        .select(
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
            "rep",
        )
        .distinct()
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["low", "high"]):
            rep, count = table.column("rep").to_numpy(), table.column("n").to_numpy()
            block = table.column("block").to_numpy()
            same = table.column("low").to_numpy() == table.column("high").to_numpy()
            rows = _matrix(table.column("v"), size)
            out: list[tuple] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                near = rows[a:b] @ rows[a:b].T >= threshold
                np.fill_diagonal(near, False)
                if not same[a]:
                    near &= block[a:b, None] != block[None, a:b]
                links = near @ count[a:b]
                root = np.arange(b - a)
                for i in np.flatnonzero(links).tolist():
                    first = True
                    for j in np.flatnonzero(near[i]).tolist():
                        if root[i] != root[j]:
                            root[root == root[j]] = root[i]
                            out.append((rep[a + i], rep[a + j], int(links[i]) if first else 0))
                            first = False
                    if first:
                        out.append((rep[a + i], rep[a + i], int(links[i])))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"]
            )

    links = materialize(
        cells.join(unique, "rep")
        .select("low", "high", "block", "rep", "n", "v")
        .repartition("low", "high")
        .sortWithinPartitions("low", "high")
        .mapInArrow(compare, "a long, b long, n long"),
        "vector-links",
    )
    found = connected_components(links)
    counts = links.groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("near"))
    return (
        unique.join(counts, unique.rep == counts.of, "left")
        .join(found, unique.rep == found.v, "left")
        .select(
            unique.v.alias("w"),
            (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
