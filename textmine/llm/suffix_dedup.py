"""Removal of repeated byte strings by suffix arrays.

Every byte inside a string of ``LENGTH`` bytes that also starts anywhere else is
marked. Only starts whose string may repeat need sorting, and equal strings have
to meet: every start is assigned the byte place with the smallest hash among the
next ``WINDOW``, its anchor, which equal strings share; so starts are grouped by
the ``PRINT`` bytes at their anchor, and groups of one anchor are left out.
Inside a group, contexts (all bytes of an anchor's starts) that are whole copies
are known by their digests: all their starts repeat, and one of them stands for
the rest. Those representatives that have others in their group are cut from the
texts and dealt out into shards. A shard sorts its suffixes in numpy by
Larsson-Sadakane refinement (ranks at depth h give ranks at depth 2h; only
suffixes that are not yet told apart go on) and computes common prefixes along
the contexts as Kasai does, all contexts in step. A group too large for a shard
is cut into several; their sorted windows are merged by binary search over
digests.

Defined cases: a null text is an empty one; texts shorter than ``LENGTH`` lose
nothing; texts are read whole; a repeated row repeats its text, so both lose it;
rows need no distinct ids; an empty table gives an empty result; other columns
are left out. A single text may have up to 2**28 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.llm.common import (
    mix,
    pieces,
    rolling,
    span_hash,
    text_bytes,
    whole_groups,
)
from textmine.sources.scratch import materialize

LENGTH = 200
#: Places among which a start has its anchor, and bytes by which anchors are grouped.
WINDOW, PRINT = 160, 41
assert WINDOW - 1 + PRINT == LENGTH
#: Contexts that a shard sorts together.
SHARD = 4096
_PLACE_BITS = 28
#: A fixed substitution of bytes, for the second half of a window's digest.
_OTHER_BYTES = np.random.default_rng(7).permutation(256).astype(np.uint8)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like the bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data),), ">u8", padded, strides=(1,))
    return view.astype(np.uint64)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(text number, first start, number of starts, print, context's digest) of every anchor."""
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - LENGTH + 1, 0)
    total = int(starts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    place = np.uint64((1 << _PLACE_BITS) - 1)
    least = (mix(words_at(data)) & ~place) | np.arange(len(data), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32, 64):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: -(WINDOW - 128)], least[WINDOW - 128 :])
    ends = np.cumsum(starts)
    at = np.repeat(offsets[:-1] - (ends - starts), starts) + np.arange(total)
    anchor = (least[at] & place).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, chosen = at[new], anchor[new]
    owner = np.searchsorted(offsets, first, side="right") - 1
    count = np.diff(np.append(new, total))
    sums = rolling(data)
    prints = span_hash(sums, chosen, chosen + PRINT)
    digests = span_hash(sums, first, first + count + LENGTH - 1)
    return owner, first - offsets[owner], count, prints, digests


def suffix_ranks(data: np.ndarray, remaining: np.ndarray) -> np.ndarray:
    """Ranks of all places by the next bytes, up to ``LENGTH`` of them.

    ``remaining`` is the number of bytes from a place to the end of its context.
    Ranks of places with fewer than ``LENGTH`` of them are ranks at a lower depth.
    """
    n = len(data)
    key = words_at(data)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    depth, step = 8, 8
    sort_key = key[order]
    base = np.zeros(n, np.int64)
    while True:
        new = np.ones(len(order), bool)
        new[1:] = sort_key[1:] != sort_key[:-1]
        lead = np.flatnonzero(new)
        size = np.diff(np.append(lead, len(order)))
        # A group's rank is that of its first member among the members of the group before.
        rank[order] = np.repeat(base[lead] + lead, size)
        if depth >= LENGTH:
            return rank
        step = min(depth, LENGTH - depth)
        depth += step
        open_ = np.repeat(size > 1, size) & (remaining[order] >= depth)
        order = order[open_]
        if not len(order):
            return rank
        own = rank[order]
        sort_key = own * (n + 1) + rank[order + step]
        by = np.argsort(sort_key)
        order, sort_key, own = order[by], sort_key[by], own[by]
        lead = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        base = own - np.repeat(lead, np.diff(np.append(lead, len(own))))


def common_prefixes(
    key: np.ndarray, first: np.ndarray, count: np.ndarray, before: np.ndarray
) -> np.ndarray:
    """Common prefix, at most ``LENGTH``, of every start with the one sorted before it.

    The starts of context c are ``count[c]`` places from ``first[c]`` on, and
    ``before`` has the sorted predecessor's place (or -1) by start number. As in
    Kasai's method a start shares with its predecessor all but one byte of what
    the start to its left shared, if that one's predecessor has a start to its
    right, too; all contexts go from left to right in step.
    """
    ends = np.cumsum(count)
    number = ends - count
    is_start = np.zeros(len(key) + 1, bool)
    is_start[np.repeat(first - number, count) + np.arange(ends[-1])] = True
    out = np.zeros(int(ends[-1]), np.int64)
    shared = np.zeros(len(first), np.int64)
    for t in range(int(count.max())):
        lane = np.flatnonzero(count > t)
        own = first[lane] + t
        other = before[number[lane] + t]
        shared[lane[other < 0]] = 0
        lane, own, other = lane[other >= 0], own[other >= 0], other[other >= 0]
        todo = np.arange(len(lane))
        known = shared[lane].copy()
        while len(todo):
            at = known[todo]
            differ = key[own[todo] + at] ^ key[other[todo] + at]
            same = np.full(len(todo), 8)
            for byte in range(8):
                same -= differ >= (1 << (8 * byte))
            known[todo] = np.minimum(at + same, LENGTH)
            todo = todo[(same == 8) & (at + 8 < LENGTH)]
        out[number[lane] + t] = known
        carried = (known < LENGTH) & (known > 0) & is_start[other + 1]
        shared[lane] = np.where(carried, known - 1, 0)
    return out


def repeated_starts(data: np.ndarray, offsets: np.ndarray, count: np.ndarray):
    """For contexts laid end to end: (start places, whether repeated, sorted start numbers, class).

    The first ``count[c]`` places of context c are its starts.
    """
    first = offsets[:-1]
    sizes = np.diff(offsets)
    remaining = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    ranks = suffix_ranks(data, remaining)
    ends = np.cumsum(count)
    place = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
    order = np.argsort(ranks[place], kind="stable")
    before = np.full(len(place), -1, np.int64)
    before[order[1:]] = place[order[:-1]]
    shared = common_prefixes(words_at(data), first, count, before)[order]
    equal = shared >= LENGTH
    again = equal.copy()
    again[:-1] |= equal[1:]
    repeated = np.zeros(len(place), bool)
    repeated[order] = again
    return place, repeated, order, np.cumsum(~equal) - 1


def window_digests(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at the given places."""
    a = span_hash(rolling(data), place, place + LENGTH)
    return a, span_hash(rolling(_OTHER_BYTES[data]), place, place + LENGTH)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column(0).to_numpy()
        data, offsets = text_bytes(batch.column(1))
        for a, b in pieces(offsets):
            own = offsets[a : b + 1]
            owner, first, count, prints, digests = anchors(data[own[0] : own[-1]], own - own[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(prints.view(np.int64)),
                    pa.array(key[a:b][owner]),
                    pa.array((first << 8) | (count - 1)),
                    pa.array(digests.view(np.int64)),
                ],
                ["print", "key", "at", "digest"],
            )


def _find_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of whole groups: which are copied, and which stand for others in a shard."""
    for table, bounds in whole_groups(batches, ["print", "salt"]):
        print_, salt = table.column("print").to_numpy(), table.column("salt").to_numpy()
        size = np.diff(bounds)
        digest = table.column("digest").to_numpy()
        order = np.lexsort((digest, np.repeat(np.arange(len(size)), size)))
        digest = digest[order]
        # Groups stay where they are, and equal contexts of a group lie side by side.
        new = np.zeros(len(order), bool)
        new[bounds[:-1]] = True
        new[1:] |= digest[1:] != digest[:-1]
        copies = np.diff(np.append(np.flatnonzero(new), len(new)))
        copied = np.repeat(copies > 1, copies)
        kinds = np.repeat(np.add.reduceat(new, bounds[:-1], dtype=np.int64), size)
        stands = new & ((kinds > 1) | (salt >= 0))
        taken = pa.array(order)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(print_, mask=~stands),
                table.column("key").take(taken).combine_chunks(),
                table.column("at").take(taken).combine_chunks(),
                pa.array(salt, mask=~stands),
                pa.array(copied),
            ],
            ["print", "key", "at", "salt", "copied"],
        )


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each anchor that a text has in a shard."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        data, offsets = text_bytes(batch.column(1))
        spots = batch.column(2)
        struct, bounds = spots.values.slice(
            spots.offsets[0].as_py(), spots.offsets[-1].as_py() - spots.offsets[0].as_py()
        ), spots.offsets.to_numpy()
        columns = [struct.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
        owner = np.repeat(np.arange(len(key)), np.diff(bounds))
        first, last = columns[1] >> 8, columns[1] & 255
        begin = offsets[owner] + first
        size = last + LENGTH
        for a in range(0, len(owner), 20_000):
            part = slice(a, a + 20_000)
            ends = np.concatenate([[0], np.cumsum(size[part])])
            take = np.repeat(begin[part] - ends[:-1], size[part]) + np.arange(ends[-1])
            context = pa.Array.from_buffers(
                pa.binary(),
                len(ends) - 1,
                [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[take])],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0][part]),
                    pa.array(key[owner[part]]),
                    pa.array(columns[1][part]),
                    pa.array(columns[2][part].astype(np.int32)),
                    pa.array(columns[3][part]),
                    context,
                ],
                ["print", "key", "at", "salt", "copied", "context"],
            )


_RESULT = "key long, at long, marks binary, d1 long, d2 long, place int"


def _marks(
    repeated: np.ndarray, count: np.ndarray, asked: np.ndarray
) -> tuple[np.ndarray, list[bytes]]:
    """Those asked-for contexts that have a repeated start, and their starts as packed bits."""
    ends = np.cumsum(count)
    some = np.flatnonzero(np.logical_or.reduceat(repeated, ends - count) & asked)
    return some, [np.packbits(repeated[ends[c] - count[c] : ends[c]]).tobytes() for c in some]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of starts that repeat in their shard; from cut groups also their windows' digests."""
    for table, bounds in whole_groups(batches, ["print", "salt"], SHARD):
        # Whole groups up to a shard's size; a single larger group is a shard.
        a = 0
        while a < len(bounds) - 1:
            b = int(np.searchsorted(bounds, bounds[a] + SHARD, side="right")) - 1
            b = max(b, a + 1)
            shard = table.slice(int(bounds[a]), int(bounds[b] - bounds[a]))
            a = b
            data, offsets = text_bytes(shard.column("context"))
            key, at = shard.column("key").to_numpy(), shard.column("at").to_numpy()
            copied = shard.column("copied").to_numpy()
            count = np.diff(offsets) - LENGTH + 1
            place, repeated, order, class_ = repeated_starts(data, offsets, count)
            # Every start of a copied context repeats, and its marks are known.
            repeated |= np.repeat(copied, count)
            some, marks = _marks(repeated, count, ~copied)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[some]),
                    pa.array(at[some]),
                    pa.array(marks, pa.binary()),
                    none,
                    none,
                    pa.nulls(len(some), pa.int32()),
                ],
                ["key", "at", "marks", "d1", "d2", "place"],
            )
            cut = shard.column("salt").to_numpy() >= 0
            if cut.any():
                owner = np.repeat(np.arange(len(count)), count)
                lead = order[np.concatenate([[True], class_[1:] != class_[:-1]])]
                lead = lead[cut[owner[lead]]]
                d1, d2 = window_digests(data, place[lead])
                who = owner[lead]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[who]),
                        # A window that repeats in its shard is marked already.
                        pa.array(at[who], mask=repeated[lead]),
                        pa.nulls(len(lead), pa.binary()),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array((place[lead] - offsets[who]).astype(np.int32)),
                    ],
                    ["key", "at", "marks", "d1", "d2", "place"],
                )


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of windows that stand in several shards, from rows sorted by digest."""
    for table, _ in whole_groups(batches, ["d1"]):
        d1, d2 = table.column("d1").to_numpy(), table.column("d2").to_numpy()
        order = np.lexsort((d2, d1))
        pair = np.stack([d1[order], d2[order]], 1).view([("a", np.int64), ("b", np.int64)])[:, 0]
        found = np.searchsorted(pair, pair, side="right") - np.searchsorted(pair, pair, side="left")
        at = table.column("at").combine_chunks()
        rows = order[(found > 1) & ~np.asarray(at.is_null())[order]]
        first = at.fill_null(0).to_numpy()[rows]
        place = table.column("place").to_numpy()[rows]
        marks = []
        for n in place.tolist():
            bits = np.zeros(n + 1, np.uint8)
            bits[n] = 1
            marks.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(table.column("key").to_numpy()[rows]),
                pa.array(first),
                pa.array(marks, pa.binary()),
            ],
            ["key", "at", "marks"],
        )


def removed_runs(spots: list[tuple[int, bytes | None]], size: int) -> np.ndarray:
    """Maximal runs [start, end) covered by the marked windows of one text; None marks all."""
    edge = np.zeros(size + 1, np.int64)
    whole = np.array([at for at, marks in spots if marks is None], np.int64)
    # All starts of a copied context are marked, so its bytes are covered without a gap.
    np.add.at(edge, whole >> 8, 1)
    np.add.at(edge, (whole >> 8) + (whole & 255) + LENGTH, -1)
    for at, marks in spots:
        if marks is None:
            continue
        start = (at >> 8) + np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8)))
        edge[start] += 1
        edge[start + LENGTH] -= 1
    # Equal windows may be marked twice; what counts is whether any covers a byte.
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            texts = part.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            spots = part.column(2).to_pylist()
            kept, runs = [], []
            for text, own in zip(texts, spots, strict=True):
                found = np.zeros((0, 2), np.int64)
                if own:
                    found = removed_runs([(s["at"], s["marks"]) for s in own], len(text))
                edges = [0, *found.ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                runs.append([{"start": a, "end": b} for a, b in found.tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                ["id", "n_bytes", "runs", "kept_sha256", "kept"],
            )


def remove_repeats(
    df: DataFrame, *, id_col: str = "doc_id", text: str = "text", shard: int = SHARD
) -> DataFrame:
    """``<id, n_bytes, runs: array<struct<start, end>>, kept_sha256, kept: binary>`` per row.

    ``shard`` is the number of anchors with equal bytes from which on a group is
    cut into several shards.
    """
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.xxhash64(F.col(id_col), F.col(text)), F.lit(0)).alias("key"),
        F.col(text).alias("text"),
    )
    spots = rows.select("key", "text").mapInArrow(
        _find_anchors, "print long, key long, at long, digest long"
    )
    repeated = (
        spots.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )
    # A salt of -1 says that the group is whole.
    salt = F.when(
        F.col("n") > shard,
        F.expr(f"cast(pmod(xxhash64(key, at), ceil(n / {int(shard)})) as int)"),
    ).otherwise(-1)
    copies = materialize(
        spots.join(repeated, "print")
        .select("print", "key", "at", "digest", salt.alias("salt"))
        .repartition("print", "salt")
        .sortWithinPartitions("print", "salt")
        .mapInArrow(_find_copies, "print long, key long, at long, salt int, copied boolean"),
        "copied-contexts",
    )
    wanted = (
        copies.where("print is not null")
        .select("key", F.struct("print", "at", "salt", "copied").alias("spot"))
        .groupBy("key")
        .agg(F.collect_list("spot").alias("spots"))
    )
    contexts = (
        rows.select("key", "text")
        .dropDuplicates(["key"])
        .join(wanted, "key")
        .select("key", "text", "spots")
        .mapInArrow(
            _cut_contexts,
            "print long, key long, at long, salt int, copied boolean, context binary",
        )
    )
    found = materialize(
        contexts.repartition("print", "salt")
        .sortWithinPartitions("print", "salt")
        .mapInArrow(_sort_shards, _RESULT),
        "repeats",
    )
    merged = (
        found.where("d1 is not null")
        .repartition("d1")
        .sortWithinPartitions("d1")
        .mapInArrow(_merge_shards, "key long, at long, marks binary")
    )
    marks = (
        found.where("d1 is null")
        .select("key", "at", "marks")
        .union(merged)
        .union(copies.where("copied").select("key", "at", F.lit(None).cast("binary")))
        .groupBy("key")
        .agg(F.collect_list(F.struct("at", "marks")).alias("spots"))
    )
    return (
        rows.join(marks, "key", "left")
        .select("id", "text", "spots")
        .mapInArrow(
            _cut_texts,
            f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, "
            "runs array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary",
        )
        .withColumnRenamed("id", id_col)
    )
