"""Hard negatives by an R-tree packed sort-tile-recursively.

For an anchor, the best rows of its own label are its positives; for each positive, the
best rows of other labels whose score lies in a window below the positive's are the hard
negatives. Scores are exact integer inner products.

The tree. Rows are tiled by sort-tile-recursive packing: coordinates in descending order of
variance are cut into slices of equal size, each slice is cut by the next coordinate. The
cuts of the upper levels come from a bounded sample; every row falls into one tile, a tile's
rows are packed in full inside one task, into leaves of bounded size, whose boxes (least and
greatest value of each coordinate) form the levels above. A tile that holds more rows than
the sample promised is packed in pieces. Pieces are dealt out to shards in turn, so that each
shard spans the whole space.

The search. For an anchor a and a box, the sum over coordinates of the smaller and of the
larger of a*low and a*high bounds all inner products in the box. A queue ordered by the upper
bound opens the best box first; a box is left out where its interval misses the score window
or lies strictly below the k-th score found so far (rows of equal score may still win by id).
Anchors travel in blocks to every shard, so a shard is held by one task and read once. The
first search sees one of 32 shards; what it finds bounds the second search over the others,
which therefore returns few rows for each anchor, however many shards there are.

Rows of equal vector and label score alike, so of each such group only the smallest ids can
be among the first k; the others leave before the tree is built, by a window whose limit
Spark applies before its shuffle.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part; an empty vector or one of zeros takes part with score 0; vectors
are compared with those of the same number of components only; exactly repeated rows count
once; a row never pairs with one of its own id; ties go to the smaller id; scores must fit
in 56 bits, else the job fails with a message; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmine.llm.common import list_arrays, whole_groups
from textmine.sources.scratch import materialize

#: Rows of a leaf, children of an inner node, rows of a tile, rows of a shard at most.
LEAF, FANOUT, TILE_ROWS, SHARD_ROWS = 128, 16, 4096, 32_768
#: Bytes of vectors in a shard at most, which lowers its rows for long vectors.
SHARD_BYTES = 32 << 20
#: Rows of the sample that the upper cuts come from.
SAMPLE_ROWS = 16_384
#: Anchors searched together, and the share of shards that the first search sees.
ANCHORS, FIRST_SHARE = 256, 32

LOWEST, HIGHEST = -(1 << 62), 1 << 62


# ---- packing


@dataclass
class Cut:
    """A tiling: slices of a coordinate, each with a tiling of its own; or one tile."""

    tile: int = 0
    coordinate: int = 0
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slices: list[Cut] = field(default_factory=list)


def _slice_count(parts: int, coordinates: int) -> int:
    """Slices of a coordinate, of which ``coordinates`` are left, for so many parts."""
    return int(np.ceil(parts ** (1 / max(coordinates, 1)) - 1e-9))


def _directions(points: np.ndarray) -> np.ndarray:
    """Coordinates in the order in which they are cut."""
    return np.argsort(-points.astype(np.float64).var(0), kind="stable")


def cut_space(points: np.ndarray, tiles: int) -> tuple[Cut, int]:
    """Sort-tile-recursive cuts of a sample into about ``tiles`` tiles; how many there are."""
    order = _directions(points) if len(points) else np.zeros(0, np.int64)
    made = 0

    def cut(rows: np.ndarray, parts: int, depth: int) -> Cut:
        nonlocal made
        if parts <= 1 or depth >= len(order) or len(rows) < 2:
            made += 1
            return Cut(tile=made - 1)
        n = _slice_count(parts, len(order) - depth)
        values = np.sort(points[rows, order[depth]])
        bounds = values[[len(rows) * i // n for i in range(1, n)]]
        which = np.searchsorted(bounds, points[rows, order[depth]], side="right")
        rest = -(-parts // n)
        slices = [cut(rows[which == i], rest, depth + 1) for i in range(n)]
        return Cut(coordinate=int(order[depth]), bounds=bounds, slices=slices)

    return cut(np.arange(len(points)), tiles, 0), made


def tile_of(points: np.ndarray, cuts: Cut) -> np.ndarray:
    """The tile of each point."""
    out = np.full(len(points), cuts.tile)
    if cuts.slices:
        which = np.searchsorted(cuts.bounds, points[:, cuts.coordinate], side="right")
        for i, below in enumerate(cuts.slices):
            rows = np.flatnonzero(which == i)
            if len(rows):
                out[rows] = tile_of(points[rows], below)
    return out


def pack_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The rows of each leaf, packed sort-tile-recursively; neighbours follow each other."""
    order = _directions(points)

    def tiles(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        if len(rows) <= leaf or depth >= len(order):
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        n = _slice_count(-(-len(rows) // leaf), len(order) - depth)
        rows = rows[np.argsort(points[rows, order[depth]], kind="stable")]
        # Slices hold whole leaves, so that only the last leaf is not full.
        size = -(-len(rows) // (n * leaf)) * leaf
        return [
            part
            for i in range(0, len(rows), size)
            for part in tiles(rows[i : i + size], depth + 1)
        ]

    return tiles(np.arange(len(points)), 0)


# ---- searching


class Tree:
    """Boxes over leaves; the leaves' points, ids and labels."""

    def __init__(self, leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.leaves = leaves
        low = np.array([points.min(0) for points, _, _ in leaves])
        high = np.array([points.max(0) for points, _, _ in leaves])
        self.levels = [(low, high)]
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((low, high))

    def search(self, wanted: Wanted) -> None:
        """Offer each leaf that may hold a result of some query, best upper bound first."""
        bounds = []
        up, down = np.maximum(wanted.points, 0), np.minimum(wanted.points, 0)
        for low, high in self.levels:
            bounds.append((up @ low.T + down @ high.T, up @ high.T + down @ low.T))
        top = len(self.levels) - 1
        queue: list[tuple] = []

        def push(level: int, node: int) -> None:
            least, most = bounds[level][0][:, node], bounds[level][1][:, node]
            open_to = wanted.open_to(least, most)
            if open_to.any():
                heapq.heappush(queue, (-int(most[open_to].max()), level, node))

        for node in range(len(self.levels[top][0])):
            push(top, node)
        while queue:
            _, level, node = heapq.heappop(queue)
            least, most = bounds[level][0][:, node], bounds[level][1][:, node]
            open_to = wanted.open_to(least, most)  # later finds may have closed it
            if not open_to.any():
                continue
            if level:
                below = len(self.levels[level - 1][0])
                for child in range(node * FANOUT, min((node + 1) * FANOUT, below)):
                    push(level - 1, child)
            else:
                wanted.offer(np.flatnonzero(open_to), *self.leaves[node])


class Wanted:
    """Queries of a block of anchors: the first k rows of a label condition and a window.

    A query belongs to an anchor; ``low`` and ``high`` bound its scores, ``kth`` is a score
    that k rows are known to reach.
    """

    def __init__(self, points, ids, labels, of, low, high, k: int, same_label: bool):
        self.points, self.ids, self.labels = points, ids, labels
        self.of, self.low, self.high, self.k = of, low.copy(), high, k
        self.same_label = same_label
        self.empty = np.zeros((0, 3), np.int64)
        self.found = self.empty
        self.waiting: list[np.ndarray] = []
        self.waiting_rows = 0

    def open_to(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Anchors with a query that a box of these bounds may serve."""
        alive = (most[self.of] >= self.low) & (least[self.of] <= self.high)
        out = np.zeros(len(self.ids), bool)
        out[self.of[alive]] = True
        return out

    def offer(self, anchors: np.ndarray, points, ids, labels) -> None:
        scores = np.full((len(self.ids), len(ids)), LOWEST, np.int64)
        fits = (labels == self.labels[anchors, None]) == self.same_label
        fits &= ids != self.ids[anchors, None]
        score = (self.points[anchors] @ points.T).astype(np.int64)
        scores[anchors] = np.where(fits, score, LOWEST)
        scores = scores[self.of]
        hit = (scores >= self.low[:, None]) & (scores <= self.high[:, None]) & (scores > LOWEST)
        query, at = np.nonzero(hit)
        if len(query):
            self.waiting.append(np.column_stack([query, scores[query, at], ids[at]]))
            self.waiting_rows += len(query)
            if self.waiting_rows > 2 * self.k * len(self.of):
                self.settle()

    def settle(self) -> None:
        """Keep the first k rows of each query, and raise its least score to the k-th."""
        rows = np.concatenate([self.found, *self.waiting])
        self.waiting, self.waiting_rows = [], 0
        rows = rows[np.lexsort([rows[:, 2], -rows[:, 1], rows[:, 0]])]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - first
        self.found = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.low[full[:, 0]] = np.maximum(self.low[full[:, 0]], full[:, 1])


# ---- the jobs


def _number_type(size: int, most: int) -> type:
    """A type in which the scores of ``size`` components up to ``most`` are exact."""
    if size * most * most < 1 << 53:
        return np.float64
    if size * most * most < 1 << 56:
        return np.int64
    raise ValueError("components are so large that a score may not fit in 56 bits")


def _points(data: bytes, rows: int) -> np.ndarray:
    width = data[0]
    flat = np.frombuffer(data, f"<i{width}", offset=1)
    return flat.reshape(rows, -1).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def _packed(points: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them all, after a byte that names it."""
    most = int(np.abs(points).max()) if points.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + points.astype(f"<i{width}").tobytes()


_BLOCK = (
    "shard int, kind int, size int, ids array<long>, labels array<long>, points binary, "
    "of array<int>, low array<long>, high array<long>, numbers array<long>"
)


def _usable(vector: Column) -> Column:
    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return ~F.exists(vector, odd)


def index_rows(
    df: DataFrame, *, id_col: str, vector: str, label: str, scale: int
) -> DataFrame:
    """``<id, label, v>``: the rows that take part, once each, with integer components."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    ).where(
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & _usable(F.col("v"))
    )
    whole = F.transform("v", lambda x: F.floor(x * scale))
    return rows.select("id", "label", whole.alias("v"))


def _shards(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The packed leaves of the rows that can be among the first ``k`` of a query, by shard."""
    spark = rows.sparkSession
    # Ranks count ids, so repeated rows share one; k + 1, as the anchor itself may stand first.
    alike = Window.partitionBy("v", "label").orderBy("id")
    first = rows.select("*", F.dense_rank().over(alike).alias("rank")).where(f"rank <= {k + 1}")
    kept = materialize(
        first.select("v", "label", "id").distinct().withColumn("size", F.size("v")), "tree-rows"
    )
    # One row per vector length: how many rows there are.
    sizes = {r["size"]: r["n"] for r in kept.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    cells = max(1, sum(n * size for size, n in sizes.items()))
    sampled = max(1, min(SAMPLE_ROWS, SHARD_BYTES * total // (8 * cells)))
    sample = (
        kept.orderBy(F.xxhash64("id", "label"), "id").limit(sampled).select("size", "v").toArrow()
    )
    cuts: dict[int, Cut] = {}
    first_tile: dict[int, int] = {}
    tiles = 0
    for size, n in sorted(sizes.items()):
        mine = sample.filter(pa.array(sample["size"].to_numpy() == size))
        points = list_arrays(mine["v"])[0].reshape(mine.num_rows, size)
        parts = min(-(-n // TILE_ROWS), max(1, mine.num_rows // 4))
        cuts[size], made = cut_space(points, parts)
        first_tile[size], tiles = tiles, tiles + made
    shared = spark.sparkContext.broadcast((cuts, first_tile))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, first_tile = shared.value
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            tile = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                flat, _ = list_arrays(batch.column("v").take(pa.array(rows)))
                points = flat.reshape(len(rows), size)
                tile[rows] = first_tile[size] + tile_of(points, cuts[size])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"]
            )

    tiled = materialize(
        kept.mapInArrow(place, "v array<long>, label long, id long, size int, tile long"),
        "tree-tiles",
    )
    # A tile with more rows than expected is packed in pieces, dealt by the id.
    counts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / (2 * TILE_ROWS)).alias("pieces"))
    per_shard = max(LEAF, min(SHARD_ROWS, SHARD_BYTES * total // (8 * cells)))
    n_shards = max(-(-total // per_shard), min(tiles, spark.sparkContext.defaultParallelism), 1)
    pieces = tiled.join(counts, "tile").select(
        "id",
        "label",
        "size",
        "v",
        "tile",
        F.expr("cast(pmod(xxhash64(id), pieces) as long)").alias("piece"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["tile", "piece"]):
            flat, offsets = list_arrays(table["v"])
            ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
            tile, piece = table["tile"].to_numpy(), table["piece"].to_numpy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                points = flat[offsets[a] : offsets[b]].reshape(b - a, -1)
                leaves = pack_leaves(points) if points.shape[1] else [np.arange(b - a)]
                for rows in leaves:
                    yield _block(
                        int(tile[a] + piece[a]) % n_shards,
                        0,
                        ids[a:b][rows],
                        labels[a:b][rows],
                        points[rows],
                    )

    leaves = (
        pieces.repartition("tile", "piece")
        .sortWithinPartitions("tile", "piece", "id", "label")
        .mapInArrow(pack, _BLOCK)
    )
    return materialize(leaves, "tree-leaves"), n_shards


def _block(shard, kind, ids, labels, points, of=(), low=(), high=(), numbers=()):
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([shard], pa.int32()),
            "kind": pa.array([kind], pa.int32()),
            "size": pa.array([points.shape[1]], pa.int32()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "labels": pa.array([labels], pa.list_(pa.int64())),
            "points": pa.array([_packed(points)], pa.binary()),
            "of": pa.array([of], pa.list_(pa.int32())),
            "low": pa.array([low], pa.list_(pa.int64())),
            "high": pa.array([high], pa.list_(pa.int64())),
            "numbers": pa.array([numbers], pa.list_(pa.int64())),
        }
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors with their queries, from ``<id, label, v, queries>`` rows."""
    for batch in batches:
        lengths = np.array([len(v) for v in batch.column("v")], np.int64)
        for size in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == size)
            for i in range(0, len(mine), ANCHORS):
                rows = pa.array(mine[i : i + ANCHORS])
                flat, _ = list_arrays(batch.column("v").take(rows))
                asked = batch.column("queries").take(rows)
                each, bounds = asked.flatten(), asked.offsets.to_numpy()
                yield _block(
                    0,
                    1,
                    batch.column("id").take(rows).to_numpy(),
                    batch.column("label").take(rows).to_numpy(),
                    flat.reshape(len(rows), size),
                    np.repeat(np.arange(len(rows)), np.diff(bounds)),
                    *[each.field(n).to_numpy() for n in ("low", "high", "number")],
                )


def _searcher(k: int, same_label: bool):
    """Each shard's tree, searched for every block of anchors that follows its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, leaves, trees, most = None, {}, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, leaves, trees, most = row["shard"], {}, {}, {}
                size = row["size"]
                ids, labels = (np.array(row[n], np.int64) for n in ("ids", "labels"))
                points = _points(row["points"], len(ids))
                largest = int(np.abs(points).max()) if points.size else 0
                if not row["kind"]:
                    leaves.setdefault(size, []).append((points, ids, labels))
                    most[size] = max(most.get(size, 0), largest)
                    continue
                if size not in leaves or not len(row["of"]):
                    continue
                exact = _number_type(size, max(largest, most[size]))
                if (size, exact) not in trees:
                    trees[size, exact] = Tree(
                        [(p.astype(exact), i, c) for p, i, c in leaves[size]]
                    )
                of, low, high, numbers = (
                    np.array(row[n], np.int64) for n in ("of", "low", "high", "numbers")
                )
                wanted = Wanted(
                    points.astype(exact), ids, labels, of, low, high, k, same_label
                )
                trees[size, exact].search(wanted)
                wanted.settle()
                query, score, found = wanted.found.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[query]), pa.array(found), pa.array(score)],
                    ["number", "found", "score"],
                )

    return run


def _first(
    anchors: DataFrame, leaves: DataFrame, shards: int, k: int, same_label: bool, name: str
) -> DataFrame:
    """``<number, found, score, rank>``: the first ``k`` rows of every query.

    ``anchors``: ``<a, id, label, v, queries>``; a query has a number, unique in all, and
    the lowest and highest score it takes.
    """
    early = -(-shards // FIRST_SHARE)

    def searched(asking: DataFrame, first: int, last: int) -> DataFrame:
        blocks = asking.select("id", "label", "v", "queries").mapInArrow(_blocks, _BLOCK)
        sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        tree = leaves.where(F.col("shard").between(first, last - 1))
        return (
            tree.union(sent.select(tree.columns))
            .repartition(last - first, "shard")
            .sortWithinPartitions("shard", "kind")
            .mapInArrow(_searcher(k, same_label), "number long, found long, score long")
        )

    by_rank = Window.partitionBy("number").orderBy(F.desc("score"), "found")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(by_rank)).where(f"rank <= {k}")

    seen = materialize(ranked(searched(anchors, 0, early)), f"{name}-early")
    if early == shards:
        return seen
    known = seen.where(f"rank = {k}").select("number", F.col("score").alias("kth"))
    asked = (
        anchors.select("a", F.explode("queries").alias("q"))
        .select("a", "q.*")
        .join(known, "number", "left")
        .select(
            "a",
            F.struct(
                "number", F.greatest("low", F.coalesce("kth", "low")).alias("low"), "high"
            ).alias("q"),
        )
        .groupBy("a")
        .agg(F.collect_list("q").alias("queries"))
    )
    late = searched(anchors.drop("queries").join(asked, "a"), early, shards)
    return materialize(ranked(seen.drop("rank").union(late)), name)


def mine(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchors: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """``<anchor_id, positive_id, rank, negative_id, positive_score, negative_score>``.

    ``anchors`` is a condition on ``id`` and ``label`` (default: ids divisible by 100).
    A negative's score must lie between the two percentages of ``window`` of the
    positive's. Components are multiplied by ``scale`` and rounded down.
    """
    rows = index_rows(df, id_col=id_col, vector=vector, label=label, scale=scale)
    leaves, shards = _shards(rows, max(positives, negatives))
    chosen = F.col("id") % 100 == 0 if anchors is None else anchors
    # Numbered once and written, as numbers depend on how rows are dealt.
    asking = materialize(
        rows.where(chosen).distinct().withColumn("a", F.monotonically_increasing_id()), "anchors"
    )
    everything = F.array(
        F.struct(
            F.col("a").alias("number"),
            F.lit(LOWEST + 1).cast("long").alias("low"),
            F.lit(HIGHEST).cast("long").alias("high"),
        )
    )
    best = _first(
        asking.withColumn("queries", everything), leaves, shards, positives, True, "positives"
    )
    low, high = window
    asked = materialize(
        best.select(
            F.col("number").alias("a"),
            F.col("found").alias("positive_id"),
            F.col("score").alias("positive_score"),
            (F.col("number") * positives + F.col("rank") - 1).alias("number"),
            _floor(f"{low} * score + 99").alias("low"),
            _floor(f"{high} * score").alias("high"),
        ),
        "positive-windows",
    )
    return _with_negatives(asking, asked, leaves, shards, negatives)


def _floor(hundredths: str) -> Column:
    return F.expr(f"(({hundredths}) - pmod({hundredths}, 100)) div 100")


def _with_negatives(asking, asked, leaves, shards, negatives):
    queries = (
        asked.where("low <= high")
        .groupBy("a")
        .agg(F.collect_list(F.struct("number", "low", "high")).alias("queries"))
    )
    found = _first(asking.join(queries, "a"), leaves, shards, negatives, False, "negatives")
    return (
        found.join(asked.drop("low", "high"), "number")
        .join(asking.select("a", F.col("id").alias("anchor_id")), "a")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("found").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
