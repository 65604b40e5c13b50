from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from textmine.functions.sets import prefix_length, short_prefix_length, size_band
from textmine.functions.text import id_pair_line
from textmine.operators import ranking, setjoin
from textmine.plans.jobs import jaccard_self_join
from textmine.sources.scratch import materialize

SCHEMA = "id bigint, period string, words array<string>"


def brute(rows, tau, cross_period=True):
    sets = [(i, p, set(w) - {""}) for i, p, w in rows]
    out = []
    for i, p, a in sets:
        for j, q, b in sets:
            if i < j and a and b and (p != q or not cross_period):
                sim = len(a & b) / len(a | b)
                if sim >= tau:
                    out.append((i, j, sim))
    return sorted(out)


@pytest.fixture(scope="module")
def random_rows():
    """Copies, near copies and unrelated records over a skewed vocabulary."""
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    base = [rng.choices(vocabulary, weights, k=rng.randint(1, 25)) for _ in range(30)]
    rows = []
    for i in range(240):
        words = list(rng.choice(base)) if i % 3 else list(base[0])
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words.append(f"only{i}")
        rows.append((i * 3, rng.choice("xyz"), words))
    return rows + [(9_000, "x", []), (9_001, "y", [""])]


@pytest.fixture(scope="module")
def random_records(spark, random_rows):
    return spark.createDataFrame(random_rows, SCHEMA).repartition(3)


def test_token_order(parsed):
    rows = tuples(ranking.token_order(parsed))
    assert len(rows) == 40
    assert rows[:2] == [("adelaide", 1), ("aid", 1)]
    assert rows[-4:] == [("shopping", 2), ("china", 3), ("coronavirus", 4), ("economy", 4)]


def test_rarity_sorted(parsed):
    rows = {r.id: r.tokens for r in ranking.rarity_sorted(parsed).collect()}
    assert rows[0] == ["adelaide", "centre", "stabbed", "woman", "shopping"]
    assert rows[4] == ["aid", "foriegn", "pacific", "china", "coronavirus", "economy"]


def test_prefix_tokens_on_shared_tokens(parsed):
    assert sorted((r.token, r.id) for r in ranking.shared_tokens(parsed, 0.1).collect()) == [
        ("china", 4),
        ("china", 5),
        ("china", 8),
        ("coronavirus", 2),
        ("coronavirus", 3),
        ("coronavirus", 4),
        ("coronavirus", 7),
        ("economy", 1),
        ("economy", 2),
        ("economy", 4),
        ("economy", 6),
        ("shopping", 0),
        ("shopping", 7),
    ]
    assert ranking.prefix_tokens(parsed, 0.1).count() == 49
    assert ranking.prefix_tokens(parsed, 1.0).count() == 9


TENTH = [(0, 7), (1, 2), (1, 4), (1, 6), (2, 6), (2, 7), (4, 6), (4, 7), (4, 8)]


@pytest.mark.parametrize(
    ("tau", "pairs"),
    [
        (0.1, TENTH),
        (0.0001, sorted([*TENTH, (3, 7), (5, 8)])),
        (0.125, [(1, 2), (1, 6), (2, 6), (2, 7)]),
        (0.13, [(2, 6)]),
        (1.0, []),
    ],
)
def test_fixture(parsed, tau, pairs):
    assert [(r.id1, r.id2) for r in jaccard_self_join(parsed, tau).collect()] == pairs


def test_fixture_similarities(parsed):
    rows = {(a, b): s for a, b, s in tuples(jaccard_self_join(parsed, 0.1))}
    assert rows[0, 7] == 1 / 9 and rows[1, 2] == 0.125 and rows[2, 6] == 1 / 7 and rows[4, 8] == 0.1


def test_fixture_text(parsed):
    pairs = jaccard_self_join(parsed, 0.125)
    lines = pairs.select(id_pair_line(*(F.col(c) for c in pairs.columns)))
    assert tuples(lines)[0] == ("(1,2)    0.125",)


@pytest.mark.parametrize("tau", [0.05, 0.3, 0.5, 0.7, 0.9, 1.0])
def test_against_brute_force(random_records, random_rows, tau):
    assert tuples(jaccard_self_join(random_records, tau)) == brute(random_rows, tau)


def test_within_a_period_too(random_records, random_rows):
    got = tuples(jaccard_self_join(random_records, 0.6, cross_period=False))
    assert got == brute(random_rows, 0.6, cross_period=False)


def test_blocks_change_nothing(random_records, random_rows, monkeypatch):
    """Lists and groups of copies far above the block size give the same pairs."""
    seen = []
    original = setjoin._blocked
    monkeypatch.setattr(setjoin, "_blocked", lambda *a: seen.append(1) or original(*a))
    similar = setjoin.similar_sets(random_records, 0.3, block=3)
    assert len(seen) == 2
    pairs = setjoin.expand(similar, block=4).orderBy("id1", "id2")
    assert tuples(pairs) == brute(random_rows, 0.3)


def test_candidate_join_is_a_merge_join(random_records):
    records = materialize(setjoin.token_sets(random_records), "records")
    sets = materialize(setjoin.distinct_sets(records), "sets")
    ranks = materialize(setjoin.token_ranks(records), "ranks")
    encoded = materialize(setjoin.encode_sets(records, sets, ranks), "encoded")
    plan = setjoin.candidate_sets(encoded, ranks, 0.5)._jdf.queryExecution().executedPlan()
    assert "SortMergeJoin" in plan.toString() and "BroadcastHashJoin" not in plan.toString()


def test_compact_form_counts_copies(random_records, random_rows):
    similar = setjoin.similar_sets(random_records, 0.8, cross_period=False)
    other = similar.pairs.where("set1 <> set2").agg(F.sum(F.col("copies1") * F.col("copies2")))
    same = similar.pairs.where("set1 = set2").agg(F.sum(F.col("copies1") * (F.col("copies1") - 1) / 2))
    total = (other.head()[0] or 0) + same.head()[0]
    assert total == len(brute(random_rows, 0.8, cross_period=False))
    assert similar.members.count() == len(random_rows) - 2


def test_exact_threshold_is_kept(spark):
    shared = [f"s{i}" for i in range(7)]
    rows = [(1, "x", [*shared, "a", "b"]), (2, "y", [*shared, "c"])]
    assert tuples(jaccard_self_join(spark.createDataFrame(rows, SCHEMA), 0.7)) == [(1, 2, 0.7)]


def test_repeated_tokens_count_once(spark):
    rows = [(1, "x", ["b"]), (2, "y", ["a", "a", "b"])]
    assert tuples(jaccard_self_join(spark.createDataFrame(rows, SCHEMA), 0.5)) == [(1, 2, 0.5)]


def test_same_period(spark):
    df = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "x", ["b", "a"])], SCHEMA)
    assert tuples(jaccard_self_join(df, 0.5)) == []
    assert tuples(jaccard_self_join(df, 0.5, cross_period=False)) == [(1, 2, 1.0)]


@pytest.mark.parametrize("tau", [0, -1, 1.1])
def test_tau_out_of_range(parsed, tau):
    with pytest.raises(ValueError, match="tau"):
        jaccard_self_join(parsed, tau)
    with pytest.raises(ValueError, match="tau"):
        ranking.prefix_tokens(parsed, tau)


@pytest.mark.parametrize("hundredths", [7, 35, 56, 70, 100])
def test_prefix_lengths_are_exact(spark, hundredths):
    tau, n = hundredths / 100, F.col("id")
    sizes = spark.range(1, 400)
    lengths = sizes.select("id", prefix_length(n, tau), short_prefix_length(n, tau))
    for size, length, short in tuples(lengths):
        assert length == size - -(-hundredths * size // 100) + 1
        assert short == size - -(-2 * hundredths * size // (100 + hundredths)) + 1


def test_partners_are_at_most_one_band_apart(spark):
    rows = tuples(spark.range(1, 2000).select("id", size_band(F.col("id"), 0.7)))
    band = dict(rows)
    for n in range(1, 2000):
        assert band[n] - band[max(1, math.ceil(0.7 * n))] in (0, 1)


def encoded_records(records, words):
    rows = materialize(setjoin.token_sets(records), "records")
    ranks = materialize(setjoin.token_ranks(rows), "ranks")
    sets = setjoin.distinct_sets(rows)
    return materialize(setjoin.encode_sets(rows, sets, ranks, words=words), "encoded"), ranks


def test_ranks_are_ints_without_gaps(random_records):
    encoded, ranks = encoded_records(random_records, 0)
    assert dict(encoded.dtypes)["ranks"] == "array<int>"
    assert sorted(r.rank for r in ranks.collect()) == list(range(ranks.count()))


@pytest.mark.parametrize("words", [1, 4])
def test_bitmaps_never_bound_an_overlap_too_low(random_records, words):
    encoded, _ = encoded_records(random_records, words)
    sized = encoded.withColumn("ranked", F.size("ranks"))
    pairs = sized.alias("s").join(sized.alias("l"), F.col("s.set_id") < F.col("l.set_id"))
    true = F.size(F.array_intersect("s.ranks", "l.ranks"))
    bound = setjoin.most_overlap("s", "l", [f"bits{i}" for i in range(words)])
    rows = pairs.select(true.alias("true"), bound.alias("bound")).collect()
    assert rows and all(r.true <= r.bound for r in rows)
    # Most bounds are close: tokens of a few dozen share few bits.
    if words == 4:
        assert sum(r.bound - r.true for r in rows) < 2 * len(rows)


def test_bitmaps_keep_pairs_from_verification(random_records):
    counts = []
    for words in (0, 4):
        encoded, ranks = encoded_records(random_records, words)
        counts.append(setjoin.candidate_sets(encoded, ranks, 0.3).count())
    verified = setjoin.similar_sets(random_records, 0.3).pairs.where("set1 != set2").count()
    assert verified <= counts[1] < counts[0]


def cell_lists(rng, n, first_id):
    sets = [sorted(rng.sample(range(40), rng.randint(1, 12))) for _ in range(n)]
    table = {
        "set_id": [first_id + 2 * i for i in range(n)],
        "n": [len(s) for s in sets],
        "rest": [0] * n,
        "last_rank": [s[-1] for s in sets],
        "prefix": pa.array(sets, pa.list_(pa.int32())),
    }
    return setjoin._Lists(pa.table(table)), dict(zip(table["set_id"], map(set, sets), strict=True))


@pytest.mark.parametrize(("lookups", "hits", "dense"), [(1 << 18, 1 << 22, 16), (1, 1, 0), (20, 90, 99)])
def test_cells_count_all_shared_tokens(monkeypatch, lookups, hits, dense):
    """However the work inside a cell is cut, whole sets give their exact overlaps."""
    for name, value in (("LOOKUPS", lookups), ("HITS", hits), ("DENSE", dense)):
        monkeypatch.setattr(setjoin, name, value)
    rng, tau = random.Random(5), 0.3
    s, left = cell_lists(rng, 40, 0)
    l, right = cell_lists(rng, 50, 1)
    found = {}
    for i, j, shared in setjoin.shared_in_cell(s, l, tau):
        for a, b, c in zip(s.ids[i].tolist(), l.ids[j].tolist(), shared.tolist(), strict=True):
            assert (a, b) not in found
            found[a, b] = c
    expected = {}
    for a, x in left.items():
        for b, y in right.items():
            common = len(x & y)
            smaller = (len(x), a) < (len(y), b) and len(x) >= tau * len(y)
            if smaller and common >= math.ceil(tau / (1 + tau) * (len(x) + len(y)) - 1e-9):
                expected[a, b] = common
    assert found == expected and found


def test_candidates_move_no_row_per_shared_token(random_records):
    """Common tokens are counted where two blocks meet, not by grouping pairs."""
    encoded, ranks = encoded_records(random_records, 0)
    plan = setjoin.candidate_sets(encoded, ranks, 0.5)._jdf.queryExecution().executedPlan()
    assert "Aggregate" not in plan.toString()


def test_low_threshold_reads_no_arrays_again(random_records, monkeypatch):
    """Whole sets are counted, so nothing is left to verify."""
    monkeypatch.setattr(setjoin, "verify", None)
    assert setjoin.similar_sets(random_records, 0.3).pairs.count()


@pytest.mark.parametrize("tau", [0.2, 0.6])
def test_a_repeated_row_counts_its_tokens_once(spark, tau):
    rows = [(1, "x", ["a", "b", "c", "d"])] * 2 + [(2, "y", ["a", "b", "c", "e"]), (3, "z", ["e"])]
    pairs = jaccard_self_join(spark.createDataFrame(rows, SCHEMA), tau)
    expected = {(1, 2, 0.6)} | ({(2, 3, 0.25)} if tau < 0.25 else set())
    assert set(tuples(pairs)) == expected


@pytest.mark.parametrize("tau", [0.3, 0.6])
@pytest.mark.parametrize("cross_period", [True, False])
def test_rounds_change_nothing(random_records, random_rows, monkeypatch, tau, cross_period):
    """What moves at once is bounded: the cells are counted in rounds, each written."""
    monkeypatch.setattr(setjoin, "TOKENS_PER_ROUND", 1)
    written = []
    monkeypatch.setattr(setjoin, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    similar = setjoin.similar_sets(random_records, tau, cross_period=cross_period, block=3)
    assert written.count("shared") > 3
    pairs = setjoin.expand(similar, cross_period=cross_period).orderBy("id1", "id2")
    assert tuples(pairs) == brute(random_rows, tau, cross_period)


def test_rounds_grow_with_the_squares_of_sets(spark, monkeypatch):
    """Twice the blocks, twice the rounds, as a round moves a fixed multiple of the sets."""
    monkeypatch.setattr(setjoin, "TOKENS_PER_ROUND", 1)
    rows = spark.range(400).select(
        F.col("id").alias("set_id"), F.lit(3).alias("n"), F.lit(0).alias("band"), F.array(F.lit(1), F.lit(2)).alias("prefix")
    )
    monkeypatch.setattr(setjoin, "LEAST_BLOCK", 1)
    monkeypatch.setattr(setjoin, "SHARES", 1_000)
    rounds = [setjoin.blocks_by_band(rows, rows, block)[1] for block in (40, 20, 10)]
    assert rounds == [200, 200, 200]
    monkeypatch.setattr(setjoin, "SHARES", 1)
    rounds = [setjoin.blocks_by_band(rows, rows, block)[1] for block in (40, 20, 10)]
    assert rounds == [5, 10, 20]


def test_low_threshold_moves_no_pairs(random_records):
    """Copies and periods come with the sets, not by joins with pairs."""
    encoded, _ = encoded_records(random_records, 0)
    plan = setjoin.overlapping_sets(encoded, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_pairs_of_single_records_are_not_joined(spark):
    """Only sets of several records meet their members."""
    rows = [(i, "xy"[i % 2], [f"t{j}" for j in range(12) if j != i % 12]) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    similar = setjoin.similar_sets(df, 0.5)
    lone = setjoin.SimilarSets(similar.pairs, similar.members.where("false"))
    assert sorted(tuples(setjoin.expand(lone))) == brute(rows, 0.5)


def test_sets_without_a_period(spark):
    """A missing period is no other period than one that is there."""
    rows = [(1, "x", ["a", "b"]), (2, None, ["a", "b", "c"]), (3, None, ["a", "c"]), (4, "y", ["a", "b", "d"])]
    df = spark.createDataFrame(rows, SCHEMA)
    for tau in (0.2, 0.5):
        assert [(a, b) for a, b, _ in tuples(jaccard_self_join(df, tau))] == [(1, 4)]
    assert len(tuples(jaccard_self_join(df, 0.2, cross_period=False))) == 6


def test_ranks_are_dealt_by_set_before_they_are_listed(random_records):
    rows = materialize(setjoin.token_sets(random_records), "records")
    encoded = setjoin.encode_sets(rows, setjoin.distinct_sets(rows), setjoin.token_ranks(rows))
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_collect_list") :].split("\n")[1:3]
    assert any("Exchange" in line for line in below)
