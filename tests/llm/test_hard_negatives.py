"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from textmine.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=10):
    usable = {
        (i, c, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for i, v, c in rows
        if None not in (i, c) and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a, label, v in (r for r in usable if r[0] % every == 0):
        scored = [
            (-sum(x * y for x, y in zip(v, w, strict=True)), i, c)
            for i, c, w in usable
            if i != a and len(w) == len(v)
        ]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            fits = sorted(
                r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s
            )
            out += [
                (a, p, rank + 1, i, -s, -t) for rank, (t, i, _) in enumerate(fits[:negatives])
            ]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, parts=3, **options):
    got = hard.mine(spark.createDataFrame(rows, schema).repartition(parts), **options)
    assert got.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    ]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, size, seed, spread=0.3, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, size))
    points = centres[draw.integers(0, 6, n)] + spread * draw.normal(size=(n, size))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    which = draw.integers(0, labels, n).tolist()
    return [(i, p.tolist(), c) for i, (p, c) in enumerate(zip(points.astype(np.float32), which, strict=True))]


@pytest.fixture
def small(monkeypatch):
    """Small leaves, tiles and shards, so that few rows make many of each."""
    for name, value in (("LEAF", 4), ("FANOUT", 3), ("TILE_ROWS", 16), ("SHARD_ROWS", 40), ("ANCHORS", 3)):
        monkeypatch.setattr(hard, name, value)


def test_equals_brute_force(spark):
    rows = vectors(1500, 12, 1)
    assert mined(spark, rows) == brute(rows)


def test_many_small_tiles_and_shards(spark, small):
    rows = vectors(700, 5, 2)
    anchors = hard.F.col("id") % 20 == 0
    assert mined(spark, rows, anchors=anchors) == brute(rows, every=20)


def test_ties_and_a_third_of_equal_vectors(spark, small):
    draw = np.random.default_rng(3)
    rows = [(i, draw.integers(-1, 2, 3).astype(float).tolist(), int(draw.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 1.0], i % 2) for i in range(150)]
    anchors = hard.F.col("id") % 50 == 0
    assert mined(spark, rows, anchors=anchors) == brute(rows, every=50)


def test_rows_that_take_no_part_and_repeated_rows(spark):
    rows = vectors(300, 4, 4)
    rows += rows[:50] + [rows[100]] * 20  # exactly repeated rows count once
    rows += [(7, [0.5, 0.5, 0.5, 0.5], 9), (0, [0.1, 0.2, 0.3, 0.4], 1)]  # ids used twice
    rows += [
        (None, [1.0, 0.0, 0.0, 0.0], 1),
        (900, None, 1),
        (901, [1.0, None, 0.0, 0.0], 1),
        (902, [math.nan, 0.0, 0.0, 0.0], 1),
        (903, [math.inf, 0.0, 0.0, 0.0], 1),
        (904, [1.0, 0.0, 0.0, 0.0], None),
        (1000, [0.0, 0.0, 0.0, 0.0], 2),
        (1100, [], 1), (1101, [], 1), (1102, [], 2),
        (1200, [1.0, 1.0], 1), (1201, [1.0, 0.9], 1), (1202, [0.5, 0.5], 2),
        (-100, [0.3, -0.3, 0.3, 0.3], 0),
    ]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert {r[0] for r in got} >= {1100, 1200}


def test_few_rows_give_all_there_are(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (3, [0.4, 0.1], 2)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows[:2]) == []
    assert mined(spark, rows[:1]) == []


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    schema = SCHEMA + ", id int, v string, tile int, score int, rank int, number int"
    rows = [(*r, 1, "x", 2, 3, 4, 5) for r in vectors(250, 3, 6)]
    assert mined(spark, rows, schema) == brute([r[:3] for r in rows])


def test_large_components_are_exact_or_an_error(spark):
    rows = [(i, [float(x) * 2**17 for x in v], c) for i, v, c in vectors(150, 3, 7)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="56 bits"):
        mined(spark, [(i, [x * 1e30 for x in v], c) for i, v, c in vectors(150, 3, 8)])


def test_packing_fills_leaves_and_boxes_bound_all_scores():
    draw = np.random.default_rng(9)
    points = draw.integers(-200, 200, (1000, 6))
    leaves = hard.pack_leaves(points, 64)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000))
    assert all(len(rows) <= 64 for rows in leaves) and len(leaves) <= 2 * 1000 // 64
    cuts, made = hard.cut_space(points[:500], 20)
    tile = hard.tile_of(points, cuts)
    assert set(tile.tolist()) <= set(range(made)) and made >= 20
    anchor = draw.integers(-200, 200, 6)
    for rows in leaves:
        low, high = points[rows].min(0), points[rows].max(0)
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        scores = points[rows] @ anchor
        assert up @ low + down @ high <= scores.min() and scores.max() <= up @ high + down @ low


def test_boxes_outside_the_window_are_not_opened():
    points = np.arange(400)[:, None] * np.ones((1, 2), np.int64)
    leaves = [
        (points[i : i + 10].astype(np.float64), np.arange(i, i + 10), np.ones(10, np.int64))
        for i in range(0, 400, 10)
    ]
    opened = []

    class Watched(hard.Wanted):
        def offer(self, anchors, points, ids, labels):
            opened.append(int(ids[0]))
            super().offer(anchors, points, ids, labels)

    wanted = Watched(
        np.array([[1.0, 1.0]]), np.array([999]), np.array([2]), np.array([0]),
        np.array([100]), np.array([600]), 3, False,
    )
    hard.Tree(leaves).search(wanted)
    wanted.settle()
    assert wanted.found.tolist() == [[0, 600, 300], [0, 598, 299], [0, 596, 298]]
    assert opened[0] == 300 and set(opened) <= {290, 300}
