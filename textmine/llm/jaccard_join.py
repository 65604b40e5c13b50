"""Near-duplicate documents by a grouped prefix join over word shingles.

A document's set holds the 64-bit hashes of its distinct word shingles. All sets
are ordered alike, rare shingles first: by the number of shingles that share the
upper 18 bits of their hash (262,144 counts over the whole corpus, whatever its
size), then by hash. Two sets that are similar enough share one of their first
few shingles, the prefix. Documents with equal prefix and size are one group,
and the prefix join runs over groups; group pairs are filtered by size and by
the place of the shared shingle. The sets of groups with a candidate partner are
then expanded and verified exactly, and links become connected components.

Nothing is quadratic in rows: equal sets are one set, candidates are handed on
as members of cells (blocks of at most ``BLOCK`` sets against each other), and a
cell returns no more links than its sets need to be connected.

Defined cases: a null, empty or blank text has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle;
texts are read whole; repeated rows are linked like copies; a row without id
has no component; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.llm.common import (
    list_arrays,
    mix,
    pieces,
    shingle_hashes,
    text_bytes,
    whole_groups,
    word_hashes,
)
from textmine.llm.components import connected_components
from textmine.sources.scratch import discard, materialize

#: Upper bits of a hash that choose its frequency bucket.
BUCKET_BITS = 18
#: Sets in a block of a cell; sets with equal prefix and size in one group.
BLOCK = 512
GROUP_SETS = 256
#: Postings of one shingle that are compared in one place.
LIST_ROWS = 4096
#: Rows that a task works on at once.
ROWS = 20_000
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _need(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The smallest overlap of a set of ``n`` with any set similar to it."""
    return -((-n * share[0]) // share[1])


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, _, _, owner = word_hashes(data, offsets)
    return shingle_hashes(words, owner, len(offsets) - 1, k)


def shingle_frequency(df: DataFrame, *, text: str, k: int) -> np.ndarray:
    """How many shingles of all texts fall into each of the fixed number of buckets."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in pieces(offsets):
                own = offsets[a : b + 1]
                hashes, _ = _shingles(data[own[0] : own[-1]], own - own[0], k)
                total += np.bincount(
                    (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=size
                )
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = (
        df.select(text)
        .mapInArrow(count, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most 262,144 rows of two numbers
    )
    out = np.zeros(size, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def ordered_sets(
    data: np.ndarray, offsets: np.ndarray, k: int, frequency: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): every text's distinct shingles, rare ones first."""
    hashes, owner = _shingles(data, offsets, k)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    hashes = hashes[np.lexsort((hashes, frequency[bucket], owner))]
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def _totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def signatures(
    df: DataFrame,
    frequency: Broadcast,
    *,
    id_col: str,
    text: str,
    k: int,
    share: tuple[int, int],
) -> DataFrame:
    """``<id, n, grp, s1, s2, prefix>``: set size, prefix and size as one hash, set, prefix."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in pieces(offsets):
                own = offsets[a : b + 1]
                sets, bounds = ordered_sets(
                    data[own[0] : own[-1]], own - own[0], k, frequency.value
                )
                n = np.diff(bounds)
                length = np.where(n > 0, n - _need(n, share) + 1, 0)
                ends = np.concatenate([[0], np.cumsum(length)])
                take = np.repeat(bounds[:-1] - ends[:-1], length) + np.arange(ends[-1])
                prefix = sets[take]
                group = mix(_totals(mix(prefix), ends) + n.astype(np.uint64) * _OTHER)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n.astype(np.int32)),
                        pa.array(group.view(np.int64)),
                        pa.array(_totals(mix(sets), bounds).view(np.int64)),
                        pa.array(_totals(mix(sets ^ _OTHER), bounds).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(ends.astype(np.int32)), prefix.view(np.int64)
                        ),
                    ],
                    ["id", "n", "grp", "s1", "s2", "prefix"],
                )

    return df.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(
        sign, "id long, n int, grp long, s1 long, s2 long, prefix array<long>"
    )


def _candidates(share: tuple[int, int]):
    """Members of cells from postings that lie together by shingle, smaller sets first."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["token", "a", "b"], ROWS):
            column = {c: table.column(c).to_numpy() for c in table.column_names}
            n, pos, part = column["n"].astype(np.int64), column["pos"], column["part"]
            block, gid = column["block"], column["gid"]
            end = np.repeat(bounds[1:], np.diff(bounds))
            within = column["a"] == column["b"]
            at, step = np.arange(len(n)), 0
            out: list[np.ndarray] = []
            while len(at):
                step += 1
                at = at[at + step < end[at]]
                other = at + step
                similar = n[at] * den >= n[other] * num
                at, other = at[similar], other[similar]  # larger sets follow: none is similar
                # The sets overlap in this shingle and in no more than what follows it.
                most = 1 + np.minimum(n[at] - pos[at], n[other] - pos[other]) - 1
                needed = -(-(n[at] + n[other]) * num // (num + den))
                good = (most >= needed) & (within[at] | (part[at] != part[other]))
                x, y = at[good], other[good]
                if len(x):
                    low, high = np.minimum(block[x], block[y]), np.maximum(block[x], block[y])
                    rows = np.stack([np.tile(low, 2), np.tile(high, 2), np.append(gid[x], gid[y])], 1)
                    out.append(np.unique(rows, axis=0))
                    if sum(map(len, out)) > 200_000:
                        out = [np.unique(np.concatenate(out), axis=0)]
            if out:
                rows = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[:, i]) for i in range(3)], ["low", "high", "gid"]
                )

    return run


def _verify(share: tuple[int, int]):
    """Links that connect the similar sets of each cell."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["low", "high"]):
            reps = table.column("rep").to_numpy()
            values, offsets = list_arrays(table.column("tokens"))
            left, right = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    cell = offsets[a : b + 1]
                    for i, j in cell_links(values[cell[0] : cell[-1]], cell - cell[0], num, den):
                        left.append(reps[a + i])
                        right.append(reps[a + j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"]
            )

    return run


def cell_links(values: np.ndarray, offsets: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of sets, at most one less than there are sets, that connect all similar ones."""
    n = np.diff(offsets)
    _, token = np.unique(values, return_inverse=True)
    root = np.arange(len(n))
    marked = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int64)
    links = []
    for i in range(len(n) - 1):
        marked[token[offsets[i] : offsets[i + 1]]] = 1
        rest = marked[token[offsets[i + 1] :]]
        sums = np.concatenate([[0], np.cumsum(rest)])
        cuts = offsets[i + 1 :] - offsets[i + 1]
        both = sums[cuts[1:]] - sums[cuts[:-1]]
        marked[token[offsets[i] : offsets[i + 1]]] = 0
        for j in np.flatnonzero(both * den >= num * (n[i] + n[i + 1 :] - both)) + i + 1:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                links.append((i, int(j)))
    return links


def similarity_classes(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    k: int = 5,
    share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``<id, n_shingles, component_id>``: documents linked at Jaccard >= share.

    ``share`` is an exact fraction. The component is the smallest id that can be
    reached by links, the row's own included.
    """
    spark = df.sparkSession
    frequency = spark.sparkContext.broadcast(shingle_frequency(df, text=text, k=k))
    signed = materialize(
        signatures(df, frequency, id_col=id_col, text=text, k=k, share=share), "signatures"
    )
    filled = signed.where("n > 0 and id is not null")
    # The prefixes are kept once per group, and the rows without them.
    prefixes = materialize(
        filled.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")),
        "prefixes",
    )
    rows = materialize(signed.drop("prefix"), "rows")
    discard(signed)
    signed, filled = rows, rows.where("n > 0 and id is not null")

    # One row per distinct set; many sets with equal prefix and size are several groups.
    sets = filled.groupBy("grp", "s1", "s2").agg(F.min("id").alias("rep"))
    large = (
        sets.groupBy("grp")
        .agg(F.count(F.lit(1)).alias("m"))
        .where(F.col("m") > GROUP_SETS)
        .select("grp", F.ceil(F.col("m") / GROUP_SETS).alias("parts"))
    )
    sets = materialize(
        sets.join(large, "grp", "left").select(
            "grp",
            "s1",
            "s2",
            "rep",
            F.when(
                F.col("parts").isNotNull(),
                F.xxhash64("grp", F.expr("pmod(s1, parts)")),
            )
            .otherwise(F.col("grp"))
            .alias("gid"),
        ),
        "sets",
    )
    groups = sets.groupBy("grp", "gid").agg(F.count(F.lit(1)).alias("m"))
    postings = (
        groups.join(prefixes, "grp")
        .select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
        .select("token", "gid", "n", "pos")
    )
    # Shingles in one group only are left out as soon as their list is complete.
    shared = materialize(
        postings.repartition("token").sortWithinPartitions("token").mapInArrow(
            _shared_only, "token long, gid long, n int, pos int, hub long, rows long"
        ),
        "postings",
    )
    homes = shared.groupBy("gid").agg(F.min("hub").alias("home"))
    homes = materialize(homes.join(groups.select("gid", "m"), "gid"), "homes")
    blocks = homes.groupBy("home").agg(F.ceil(F.sum("m") / BLOCK).alias("blocks"))
    blocked = homes.join(blocks, "home").select(
        "gid",
        "m",
        F.xxhash64("home", F.expr("pmod(xxhash64(gid), blocks)")).alias("block"),
    )
    blocked = materialize(blocked, "blocks")
    parts = F.ceil(F.col("rows") / LIST_ROWS).cast("int")
    placed = (
        shared.drop("hub")
        .join(blocked.select("gid", "block"), "gid")
        .withColumn("part", F.expr(f"cast(pmod(xxhash64(gid, 1), {LIST_ROWS}) as int)") % parts)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(
            "token",
            F.least("part", "other").alias("a"),
            F.greatest("part", "other").alias("b"),
            "part",
            "n",
            "pos",
            "gid",
            "block",
        )
    )
    members = placed.repartition("token", "a", "b").sortWithinPartitions(
        "token", "a", "b", "n"
    ).mapInArrow(_candidates(share), "low long, high long, gid long")
    alone = groups.where("m > 1").select(
        F.col("gid").alias("low"), F.col("gid").alias("high"), "gid"
    )
    members = materialize(members.union(alone).distinct(), "members")
    discard(shared)

    # Pairs that share too few shingles of their prefixes go before whole sets are read.
    near = (
        members.join(groups.select("gid", "grp", "m"), "gid")
        .join(prefixes, "grp")
        .select("low", "high", "gid", "m", "n", "prefix")
        .repartition("low", "high")
        .sortWithinPartitions("low", "high")
        .mapInArrow(_prefix_filter(share), "low long, high long, gid long")
    )
    # Expand the groups to their sets, read from the texts again, and verify.
    wanted = (
        sets.join(near, "gid")
        .groupBy("rep", "s1", "s2")
        .agg(F.collect_set(F.struct("low", "high")).alias("cells"))
    )
    documents = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text).alias("text"))
    links = (
        documents.join(wanted, "rep")
        .select("rep", "text", "s1", "s2", "cells")
        .mapInArrow(_expand(frequency, k), "low long, high long, rep long, tokens array<long>")
        .repartition("low", "high")
        .sortWithinPartitions("low", "high")
        .mapInArrow(_verify(share), "a long, b long")
    )
    found = connected_components(links)
    classes = sets.join(found, sets.rep == found.v, "left").select(
        "grp", "s1", "s2", F.coalesce("component", "rep").alias("component")
    )
    return (
        signed.select("id", "n", "grp", "s1", "s2")
        .join(classes, ["grp", "s1", "s2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("id"))
            .when(F.col("id").isNotNull(), F.col("component"))
            .alias("component_id"),
        )
    )


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of more than one row, with their smallest member and their length."""
    for table, bounds in whole_groups(batches, ["token"]):
        sizes = np.diff(bounds)
        hub = np.minimum.reduceat(table.column("gid").to_numpy(), bounds[:-1])
        table = table.append_column("hub", pa.array(np.repeat(hub, sizes)))
        table = table.append_column("rows", pa.array(np.repeat(sizes, sizes)))
        yield from table.filter(pa.array(np.repeat(sizes > 1, sizes))).to_batches()


def _prefix_filter(share: tuple[int, int]):
    """The members of each cell that share enough of their prefixes with another one."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["low", "high"]):
            n = table.column("n").to_numpy().astype(np.int64)
            several = table.column("m").to_numpy() > 1  # a group of several sets is near itself
            values, offsets = list_arrays(table.column("prefix"))
            keep = several.copy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    cell = offsets[a : b + 1]
                    keep[a:b] |= near_prefixes(
                        values[cell[0] : cell[-1]], cell - cell[0], n[a:b], num, den
                    )
            rows = table.filter(pa.array(keep)).select(["low", "high", "gid"])
            yield from rows.to_batches()

    return run


def near_prefixes(
    values: np.ndarray, offsets: np.ndarray, n: np.ndarray, num: int, den: int
) -> np.ndarray:
    """Whether each set can be similar to another one, judging by shared prefix shingles.

    All shingles up to the earlier end of two prefixes are in both prefixes if
    the sets share them; beyond it a set has no more than what follows its prefix.
    """
    _, token = np.unique(values, return_inverse=True)
    rest = n - np.diff(offsets)
    near = np.zeros(len(n), bool)
    marked = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int64)
    for i in range(len(n) - 1):
        own = token[offsets[i] : offsets[i + 1]]
        marked[own] = 1
        sums = np.concatenate([[0], np.cumsum(marked[token[offsets[i + 1] :]])])
        marked[own] = 0
        cuts = offsets[i + 1 :] - offsets[i + 1]
        most = sums[cuts[1:]] - sums[cuts[:-1]] + np.maximum(rest[i], rest[i + 1 :])
        found = np.flatnonzero(most * (num + den) >= num * (n[i] + n[i + 1 :])) + i + 1
        if len(found):
            near[i] = True
            near[found] = True
    return near


def _expand(frequency: Broadcast, k: int):
    """The whole set of every document, once for each of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            expected = [batch.column(c).to_numpy() for c in ("s1", "s2")]
            cells = batch.column("cells").to_pylist()
            reps = batch.column("rep").to_numpy()
            for a, b in pieces(offsets):
                own = offsets[a : b + 1]
                sets, bounds = ordered_sets(
                    data[own[0] : own[-1]], own - own[0], k, frequency.value
                )
                right = (_totals(mix(sets), bounds).view(np.int64) == expected[0][a:b]) & (
                    _totals(mix(sets ^ _OTHER), bounds).view(np.int64) == expected[1][a:b]
                )
                row = np.array(
                    [i for i in range(b - a) if right[i] for _ in cells[a + i]], np.int64
                )
                place = [c for i in range(b - a) if right[i] for c in cells[a + i]]
                size = (bounds[1:] - bounds[:-1])[row]
                ends = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(bounds[row] - ends[:-1], size) + np.arange(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c["low"] for c in place], pa.int64()),
                        pa.array([c["high"] for c in place], pa.int64()),
                        pa.array(reps[a:b][row]),
                        pa.ListArray.from_arrays(
                            pa.array(ends.astype(np.int32)), sets[take].view(np.int64)
                        ),
                    ],
                    ["low", "high", "rep", "tokens"],
                )

    return run
